"""Passages of evaluation items within a corpus of mails, found with a generalised suffix automaton."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.mail import INVISIBLE, WORD, readable_parts, words
from tallyloom.session import spread, written

#: Words of evaluation items in one automaton (at most twice as many states, of about 40 bytes each); larger sets are searched block by block.
MOST_WORDS = 500_000


class Automaton:
    """Generalised suffix automaton of word sequences, whose states of ``least`` words or more know the items that hold them.

    States are rows of flat arrays. Nearly all have one transition, which is kept there; those of branching states, and of
    the root, are in dictionaries.
    """

    def __init__(self, items: list[tuple[int, list[str]]], least: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.least = least
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.word, self.following = array("i", [-1]), array("i", [-1])  # the first transition of each state
        self.more: dict[int, dict[int, int]] = {}
        paths: list[array] = []
        for _, sequence in items:
            last, path = 0, array("i")
            for word in sequence:
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                path.append(last)
            paths.append(path)
        #: For each state, the state of its shortest suffix of at least ``least`` words (0: none).
        self.passage = array("i", bytes(4 * len(self.link)))
        for state in np.argsort(np.frombuffer(self.length, np.int32), kind="stable").tolist()[1:]:
            if self.length[state] >= least:
                self.passage[state] = self.passage[self.link[state]] or state
        #: For each state that is such a suffix, the items that hold it.
        held: dict[int, list[int]] = {}
        marked = array("i", [-1]) * len(self.link)
        for number, ((item, _), path) in enumerate(zip(items, paths, strict=True)):
            for state in path:
                while self.passage[state] and marked[state] != number:
                    marked[state] = number
                    if self.passage[state] == state:
                        held.setdefault(state, []).append(item)
                    state = self.link[state]
        self.items = {state: tuple(dict.fromkeys(own)) for state, own in held.items()}

    def _next(self, state: int, word: int) -> int:
        """Where a word leads from a state; -1 for nowhere."""
        if self.word[state] == word:
            return self.following[state]
        branches = self.more.get(state)
        return branches.get(word, -1) if branches else -1

    def _lead(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.following[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _extend(self, last: int, word: int) -> int:
        """The state of the sequence so far, longer by one word."""
        if (known := self._next(last, word)) >= 0:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        state = self._add(self.length[last] + 1)
        while last >= 0 and self._next(last, word) < 0:
            self._lead(last, word, state)
            last = self.link[last]
        if last < 0:
            self.link[state] = 0
        else:
            known = self._next(last, word)
            self.link[state] = known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        return state

    def _split(self, last: int, known: int, word: int) -> int:
        """A copy of ``known`` for its words up to one more than those of ``last``."""
        copy = self._add(self.length[last] + 1)
        self.word[copy], self.following[copy] = self.word[known], self.following[known]
        if known in self.more:
            self.more[copy] = dict(self.more[known])
        self.link[copy], self.link[known] = self.link[known], copy
        while last >= 0 and self._next(last, word) == known:
            self._lead(last, word, copy)
            last = self.link[last]
        return copy

    def _add(self, length: int) -> int:
        for column, value in ((self.link, 0), (self.length, length), (self.word, -1), (self.following, -1)):
            column.append(value)
        return len(self.link) - 1

    def spans(self, sequence: list[str]) -> list[tuple[int, int, int]]:
        """(item, from, to) of each longest stretch of ``sequence`` whose windows of ``least`` words the item holds."""
        least, get = self.least, self.vocabulary.get
        if len(sequence) < least:
            return []
        ids = [get(w, -1) for w in sequence]
        # only stretches of known words can match: the automaton is back at its root after any other word
        edges = np.flatnonzero(np.diff(np.r_[False, np.array(ids) >= 0, False]))
        only, following, more, link, length = self.word, self.following, self.more, self.link, self.length
        nowhere: dict[int, int] = {}
        open_spans: dict[int, list[int]] = {}
        done: list[tuple[int, int, int]] = []
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - begin < least:
                continue
            state = matched = 0
            for i in range(begin, end):
                word = ids[i]
                while (to := following[state] if only[state] == word else more.get(state, nowhere).get(word, -1)) < 0 and state:
                    state = link[state]
                    matched = length[state]
                if to >= 0:
                    state, matched = to, matched + 1
                if matched < least:
                    continue
                for item in self.items[self.passage[state]]:
                    span = open_spans.get(item)
                    if span and i - least + 1 <= span[1]:
                        span[1] = i + 1
                    else:
                        if span:
                            done.append((item, *span))
                        open_spans[item] = [i - least + 1, i + 1]
        return sorted(done + [(item, *span) for item, span in open_spans.items()])


def _blocks(items: DataFrame, item: str, text: str, most_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Normalised items in blocks of at most ``most_words`` words (a longer item alone)."""
    block, size = [], 0
    rows = items.select(F.col(item).cast("bigint"), F.col(text)).where(F.col(item).isNotNull() & F.col(text).isNotNull())
    for key, body in rows.orderBy(item).toLocalIterator():
        sequence = words(body)
        if block and size + len(sequence) > most_words:
            yield block
            block, size = [], 0
        block.append((key, sequence))
        size += len(sequence)
    if block:
        yield block


def leaked_spans(
    documents: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", least: int = 13, most_words: int = MOST_WORDS,
) -> DataFrame:
    """Every passage of at least ``least`` successive words of an item in a text part of a mail.

    Returns ``<key>, part, <item>, from_word, to_word, n_part_words``: the longest stretches of a part (numbered
    from 0) all of whose windows of ``least`` words the item holds. Mails are read with transfer encoding, charset
    and markup undone; words are runs of letters or digits in lower case, without invisible characters. Null or
    empty texts hold nothing; repeated mails give repeated rows; items shorter than ``least`` words match nowhere.

    The items, a stated query set, go into one automaton, which is broadcast; each mail is streamed through it whole. Items of
    more than ``most_words`` words are searched block by block; the mails' words are then written to the shared folder, so that
    they are read and decoded once.
    """
    spark, kind = documents.sparkSession, dict(documents.dtypes)[key]
    given = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")))
    schema = f"`{key}` {kind}, part int, `{item}` bigint, from_word int, to_word int, n_part_words int"
    found, parsed = None, None
    blocks = _blocks(items, item, item_text, most_words)
    block, ahead = next(blocks, None), next(blocks, None)
    several = ahead is not None
    while block is not None:
        shared = spark.sparkContext.broadcast(Automaton(block, least))
        if several and parsed is None:
            parsed = written(_parsed(given))
        part = (parsed if several else given).mapInArrow(_scanner(shared, several, key, item), schema)
        found = part if found is None else found.union(part)
        block, ahead = ahead, next(blocks, None)
    return found if found is not None else spark.createDataFrame([], schema)


def _parsed(given: DataFrame) -> DataFrame:
    """``key, part, text``: the words of each text part of a mail, with blanks between them."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(at, number, " ".join(words(part))) for at, raw in enumerate(batch.column(1).to_pylist()) for number, part in enumerate(readable_parts(raw))]
            at, number, body = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(body, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "part", "text"])

    return given.mapInArrow(parse, f"key {dict(given.dtypes)['key']}, part int, text string")


def _scanner(shared, parsed: bool, key: str, item: str):
    """Streams mails, or their parsed parts, through a broadcast automaton."""

    def sequences(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
        if parsed:
            for at, (number, body) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                yield at, number, body.split()
        else:
            for at, raw in enumerate(batch.column(1).to_pylist()):
                for number, part in enumerate(readable_parts(raw)):
                    yield at, number, words(part)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = shared.value.spans
        for batch in batches:
            rows = [(at, number, *span, len(sequence)) for at, number, sequence in sequences(batch) for span in spans(sequence)]
            if rows:
                at, *columns = (pa.array(c) for c in zip(*rows, strict=True))
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), *[c.cast(t) for c, t in zip(columns, types, strict=True)]],
                    [key, "part", item, "from_word", "to_word", "n_part_words"],
                )

    return scan


def spans_to_remove(spans: DataFrame, *, key: str = "doc_id", item: str = "item_id", longest: int = 20, most_coverage: float = 0.05) -> DataFrame:
    """The rows of ``leaked_spans`` of at least ``longest`` words, or whose item's spans cover more than ``most_coverage`` of the part's words.

    Spans of an item in a part are counted as often as they occur; the spans of one part are as many as it has words at most.
    """
    n = F.col("to_word") - F.col("from_word")
    covered = F.sum(n).over(Window.partitionBy(key, "part", item))
    judged = spans.withColumn("__covered", covered)
    return judged.where((n >= longest) | (F.col("__covered") > F.lit(most_coverage) * F.col("n_part_words"))).drop("__covered")


def without_leaks(documents: DataFrame, spans: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", longest: int = 20, most_coverage: float = 0.05) -> DataFrame:
    """``<key>, part, text, n_removed``: the text parts of the mails concerned, with leaked spans cut out.

    Cut out are ``spans_to_remove`` of ``spans``, which come from ``leaked_spans`` (read once here); keys must be unique. Mails
    without a span to remove give no rows: they stay as they are. The few mails concerned are joined by measured size.
    """
    bad = spans_to_remove(spans, key=key, item=item, longest=longest, most_coverage=most_coverage)
    per_mail = bad.groupBy(key).agg(F.collect_set(F.struct("part", "from_word", "to_word")).alias("cuts"))
    joined = documents.select(key, F.col(text).alias("text")).join(per_mail, key)
    kind = dict(documents.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parts_out, texts, removed = [], [], [], []
            for row in batch.to_pylist():
                for number, part in enumerate(readable_parts(row["text"])):
                    gone = {w for c in row["cuts"] if c["part"] == number for w in range(c["from_word"], c["to_word"])}
                    if gone:
                        body = part if part.isascii() else INVISIBLE.sub("", part)
                        body = body if len(body.lower()) == len(body) else body.lower()
                        at, kept = 0, []
                        for w, match in enumerate(WORD.finditer(body)):
                            if w in gone:
                                kept.append(body[at : match.start()] if w - 1 not in gone else "")
                                at = match.end()
                        keys.append(row[key])
                        parts_out.append(number)
                        texts.append("".join(kept) + body[at:])
                        removed.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.column(0).type), pa.array(parts_out, pa.int32()), pa.array(texts, pa.string()), pa.array(removed, pa.int32())],
                [key, "part", "text", "n_removed"],
            )

    return joined.mapInArrow(cut, f"`{key}` {kind}, part int, text string, n_removed int")
