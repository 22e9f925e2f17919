from collections import defaultdict

from tests.helpers import rows

from tallyloom.llm.leaks import Automaton, leaked_spans, without_leaks
from tallyloom.llm.mail import readable_parts, words

DOCS = "doc_id bigint, text string, part int, item_id int, from_word int"


def brute(items, sequence, least):
    windows = defaultdict(set)
    for item, own in items:
        for k in range(len(own) - least + 1):
            windows[tuple(own[k : k + least])].add(item)
    covered = defaultdict(set)
    for i in range(len(sequence) - least + 1):
        for item in windows.get(tuple(sequence[i : i + least]), ()):
            covered[item].add(i)
    found = []
    for item, starts in covered.items():
        begin = end = None
        for i in sorted(starts):
            if end is not None and i <= end:
                end = i + least
            else:
                if end is not None:
                    found.append((item, begin, end))
                begin, end = i, i + least
        found.append((item, begin, end))
    return sorted(found)


def test_automaton_against_brute_force(rng):
    for _ in range(60):
        alphabet = "abc" if rng.random() < 0.5 else "abcdefgh"
        items = [(i, [rng.choice(alphabet) for _ in range(rng.randrange(0, 25))]) for i in range(6)]
        sequence = []
        while len(sequence) < 120:
            sequence += rng.choice(items)[1][rng.randrange(5) :] if rng.random() < 0.5 else [rng.choice(alphabet + "z")]
        for least in (2, 4, 7):
            assert Automaton(items, least).spans(sequence) == brute(items, sequence, least)


def test_memory_of_an_automaton(rng):
    """About 40 bytes a state for what is broadcast, items of their own words or not."""
    import pickle

    items = [(i, [f"w{rng.randrange(3000)}" for _ in range(200)]) for i in range(100)]
    items += [(100 + i, items[i][1][:150]) for i in range(50)]
    automaton = Automaton(items, 13)
    assert len(pickle.dumps(automaton)) < 60 * len(automaton.link)


def mail(body, kind="text/plain", encoding="7bit"):
    return f"From: a@b.example\nContent-Type: {kind}; charset=utf-8\nContent-Transfer-Encoding: {encoding}\n\n{body}"


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def test_found_in_every_disguise(spark):
    import base64
    import quopri

    quoted = "> > " + ITEM.replace(" six", "\n> > six").title()
    encoded = base64.b64encode(ITEM.encode()).decode()
    soft = quopri.encodestring(("x " * 30 + ITEM.replace("three", "th\u00adr\u200bee")).encode()).decode()
    marked = "<html><style>one</style><p>" + ITEM.replace("four", "<b>fo</b>ur&nbsp;") + "</p></html>"
    parted = "Content-Type: multipart/mixed; boundary=B\n\n--B\n\nhello\n--B\nContent-Type: text/csv\nContent-Disposition: attachment\n\n" + ITEM + "\n"
    apart = ITEM.replace("seven", "other seven")
    texts = [mail(quoted), mail(encoded, encoding="base64"), mail(soft, encoding="quoted-printable"), mail(marked, "text/html"), parted, mail(apart), "", None, mail("x " * 50_000 + ITEM)]
    docs = spark.createDataFrame([(i, t, 1, 1, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1, 1, 1)], DOCS)
    items = spark.createDataFrame([(9, ITEM, "t"), (8, "too short", "t"), (7, None, "t"), (None, ITEM, "t")], "item_id bigint, text string, task string")
    spans = leaked_spans(docs, items)
    assert rows(spans, "doc_id", "item_id") == [(i, 9) for i in (0, 0, 1, 2, 3, 4, 8)]
    items = items.union(spark.createDataFrame([(6, "unheard " * 20, "t")], items.schema))
    in_blocks = leaked_spans(docs, items, most_words=1)
    assert rows(in_blocks) == rows(spans)
    assert leaked_spans(docs.where("false"), items).count() == 0 and leaked_spans(docs, items.where("false")).count() == 0


def test_removal(spark):
    texts = [mail(f"Before. {ITEM}! After."), mail("nothing here")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(9, ITEM)], "item_id bigint, text string")
    spans = leaked_spans(docs, items)
    (row,) = without_leaks(docs, spans).collect()
    assert (row.doc_id, row.text, row.n_removed) == (0, "Before. ! After.", 14)
    assert words(row.text) == ["before", "after"]
    assert without_leaks(docs, spans, longest=99, most_coverage=1.0).count() == 0


def test_limits_decide(spark):
    """A short passage in a long part stays; a long one, and a short one that is much of its part, go."""
    long_item = " ".join(f"w{i}" for i in range(40))
    filler = "x " * 2000
    texts = [mail(filler + ITEM), mail(filler + long_item), mail("a b " + ITEM), mail(filler + (ITEM + " y ") * 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(9, ITEM), (8, long_item)], "item_id bigint, text string")
    spans = leaked_spans(docs, items)
    removed = lambda **limits: rows(without_leaks(docs, spans, **limits), "doc_id", "n_removed")
    assert removed() == [(1, 40), (2, 14), (3, 9 * 14)]
    assert removed(most_coverage=1.0) == [(1, 40)]
    assert removed(longest=99) == [(2, 14), (3, 9 * 14)]
    assert removed(longest=13) == [(0, 14), (1, 40), (2, 14), (3, 9 * 14)]


def test_broken_mails_are_read():
    whole = "Content-Type: multipart/mixed; boundary=\"B\"\n\npre\n--B\nContent-Type: multipart/alternative; boundary=Ba\n\n--Ba\nContent-Type: text/plain\nContent-Transfer-Encoding: base64\n\naGVsbG8gd29y"
    assert readable_parts(whole) == ["hello wor"]
    assert readable_parts("no header at all") in (["no header at all"], [""])
    assert readable_parts("Subject: x\n\nfÃ¼r") == ["für"]
    assert readable_parts(None) == [] and readable_parts("") == []
    assert readable_parts("Content-Type: image/png\n\nxxxx") == []
    assert readable_parts("Content-Type: text/plain; charset=nonsense\nContent-Transfer-Encoding: quoted-printable\n\n=E9t=E9") == ["été"]
