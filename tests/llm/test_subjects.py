from tests.helpers import rows

from tallyloom.llm.mail import running_sentences
from tallyloom.llm.subjects import clean_labels, encoded_mails, language_model, prepared_mails, shared_marks, subject_posteriors

SUBJECTS = {"law": "court judge statute appeal clause verdict", "sport": "goal league referee match striker keeper", "cookery": "oven dough sauce pan recipe yeast"}
FILLER = ["Any news on this?", "Let me know what you think.", "Sounds good to me."]


def corpus(rng, n):
    """Mails of one or two subjects in sentences of a common pattern, and what each is about by at least a quarter."""
    texts, truth = [], {}
    for i in range(n):
        about = rng.sample(list(SUBJECTS), rng.choice([0, 1, 1, 2]))
        sentences = [rng.choice(FILLER) for _ in range(2)]
        for subject in about:
            own = SUBJECTS[subject].split()
            sentences += [f"We talked about the {rng.choice(own)} and then about the {rng.choice(own)} for the whole day." for _ in range(3)]
        texts.append((i, f"Subject: hello\n\n{' '.join(sentences)}\n\n-- \nA Name\nArchivist\n", 1, "x"))
        truth[i] = set(about)
    return texts, truth


def test_held_out_accuracy(spark, rng):
    texts, truth = corpus(rng, 500)
    labelled = [(i, s.upper() + " ", "a") for i in range(150) for s in (truth[i] or {"none"})]
    labelled += [(i, rng.choice(list(SUBJECTS)), "b") for i in range(0, 150, 15)] + [(None, "law", "c"), (3, None, "c"), (4, "unheard of", "c"), *labelled[:20]]
    docs = spark.createDataFrame(texts + [(1000, None, 1, "x"), (1001, "", 1, "x")], "doc_id bigint, text string, share int, subject string")
    labels = spark.createDataFrame(labelled, "doc_id bigint, subject string, labelled_by string")
    found = subject_posteriors(docs, labels, list(SUBJECTS)).where("posterior >= 0.5")
    got = {(r.doc_id, r.subject) for r in found.collect() if r.doc_id >= 150}
    want = {(i, s) for i in range(150, 500) for s in truth[i]}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "Subject: x\n\nhello")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, subject string")
    assert subject_posteriors(docs, labels, ["law"]).count() == 0
    some = spark.createDataFrame([(1, "law")], "doc_id bigint, subject string")
    assert subject_posteriors(docs.where("false"), some, ["law"]).count() == 0


def test_notices_are_told_by_many_senders(spark):
    """A pattern that several senders share is a notice; a paragraph that only has its phrase is running text."""
    notice = "Confidential: contents may be private. {} Works answers for nothing."
    mails = [(i, f"Subject: x\n\nOwn words of mail {i}.\n\n{notice.format(name)}\n", f"s{i}@b.example") for i, name in enumerate(["Abc", "Def", "Ghi"])]
    mails += [(9, "Subject: x\n\nThe law court said: confidential: the merger was private to both sides of it.\n", "z@b.example")]
    docs = spark.createDataFrame(mails, "doc_id bigint, text string, from_addr string")
    encoded = encoded_mails(docs, "doc_id", "text", sender="from_addr", lang=None, buckets=1024)
    known = spark.createDataFrame([(0, [0])], "key bigint, named array<int>")
    found = prepared_mails(encoded.df, known, language_model(encoded.df, 1024), shared_marks(encoded.df))
    assert {r.key: (sum(r.lengths), len(r.words), r.named) for r in found.collect()} == {0: (5, 5, [0]), 1: (5, 5, None), 2: (5, 5, None), 9: (14, 14, None)}


def test_languages_are_told_by_their_words(spark):
    """Given languages may be missing or wrong."""
    english, german = "The rain fell on the long road to the old town.", "Der Regen fiel auf den langen Weg in die alte Stadt."
    rows_ = [(i, f"Subject: x\n\n{(german if i % 3 == 0 else english) * 3}\n", None if i % 5 == 0 else "en" if i == 3 else "de " if i % 3 == 0 else "EN") for i in range(30)]
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string, lang string")
    encoded = encoded_mails(docs, "doc_id", "text", sender=None, lang="lang", buckets=1024)
    known = spark.createDataFrame([], "key bigint, named array<int>")
    model = language_model(encoded.df, 1024)
    assert {r.key: r.language for r in prepared_mails(encoded.df, known, model, shared_marks(encoded.df)).collect()} == {i: int(i % 3 != 0) for i in range(30)}


def test_many_subjects(spark):
    docs = spark.createDataFrame([(i, f"Subject: x\n\nWe spoke of topic{i} and topic{i} again.\n") for i in range(120)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, f"s{i}") for i in range(120)], "doc_id bigint, subject string")
    found = subject_posteriors(docs, labels, [f"s{i}" for i in range(120)])
    assert {r.doc_id: r.subject for r in found.where("posterior >= 0.5").collect()} == {i: f"s{i}" for i in range(120)}
    assert subject_posteriors(docs, labels, []).count() == 0


def test_labels_are_cleaned(spark):
    labels = spark.createDataFrame([(1, " Law"), (1, "LAW"), (1, "none"), (2, "None "), (3, None), (None, "law"), (4, "other"), (1, "sport")], "doc_id bigint, subject string")
    assert rows(clean_labels(labels, ["law", "sport"], key="doc_id", subject="subject")) == [(1, [0, 1]), (2, [])]


def test_running_text():
    mail = (
        "Subject: x\nContent-Type: multipart/alternative; boundary=B\n\n--B\n\nMy own words here.\n\n> Quoted words\nthere.\n\nOn Mon, 1 Jan 2024 10:00:00 +0000, A B <a@b.example> wrote:\n"
        "> My own words here.\n\n-- \nA B\nTrainee\n\nCONFIDENTIAL: nothing.\n--B\nContent-Type: text/html\n\n<p>My own <b>words</b> here.</p><p class=\"sig\">A B</p>\n--B\n"
        "Content-Type: text/plain\nContent-Disposition: attachment\n\nattached words\n--B--\n"
    )
    assert [words for words, _ in running_sentences(mail)] == [["my", "own", "words", "here"], ["quoted", "words", "there"], ["confidential"], ["nothing"]]
    assert [marks != (0, 0) for _, marks in running_sentences(mail)] == [False, False, True, True]
    assert running_sentences(None) == [] and running_sentences("") == []
