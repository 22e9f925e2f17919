"""Subject areas of mails: complement naive Bayes, refined by expectation-maximization, with calibrated posteriors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.mail import running_sentences
from tallyloom.session import Written, spread, written

#: Words are hashed into so many buckets; this bounds the model, whatever the vocabulary.
BUCKETS = 1 << 17
#: Numbers of a model (languages times buckets times subjects) at most, 4 bytes each; with more subjects there are fewer buckets.
MOST_WEIGHTS = 40_000_000
#: Labelled mails used for training and calibration at most; beyond, those with the smallest hash of their id.
MOST_LABELLED = 200_000
#: Share of the mails with a language from which a language has a background of its own (so there are at most 100); others join the likeliest.
LEAST_LANGUAGE = 0.01
#: Senders whose mails have to share the mark of a notice.
LEAST_SENDERS = 3
SMOOTHING = 0.1
#: Log-odds over the background that a sentence needs to be about a subject, for the first model and after each refinement.
BARS = (1.0, 1.0, 2.0, 3.0, 3.0)
#: Once the last bar is reached, the refinement ends when the likelihood of the sentences grows by less than this share; where it falls,
#: the model before is taken.
LEAST_GAIN = 0.001
#: Words of a mail to which its mixture of subjects is drawn to the corpus mean.
PRIOR_WORDS = 10.0


@dataclass
class Model:
    """Per language, bucket and subject, log P(word) - log P(word | other than the subject)."""

    weights: np.ndarray
    mean: np.ndarray
    bar: float

    def posteriors(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """(posteriors of each sentence over subjects and none, its words, its mail, shares by mail, log likelihood) of prepared mails."""
        words, lengths, mail = _flat(batch)
        n_mails, n_subjects = batch.num_rows, self.weights.shape[2]
        language = batch.column("language").to_numpy()
        if not len(lengths):
            return np.zeros((0, n_subjects + 1)), lengths, mail, np.zeros((n_mails, n_subjects)), 0.0
        starts = np.cumsum(lengths) - lengths
        score = np.add.reduceat(self.weights[np.repeat(language[mail], lengths), words], starts, axis=0)
        score = np.c_[score, np.full(len(score), self.bar)]
        top = score.max(1, keepdims=True)
        odds = np.exp(np.maximum(score - top, -50))
        posterior = odds / odds.sum(1, keepdims=True)
        for _ in range(3):
            mixture = _by_mail(posterior * lengths[:, None], mail, n_mails) + PRIOR_WORDS * self.mean
            posterior = odds * (mixture / mixture.sum(1, keepdims=True))[mail]
            weight = posterior.sum(1, keepdims=True)
            posterior /= weight
        total = np.bincount(mail, weights=lengths, minlength=n_mails)
        share = _by_mail(posterior[:, :-1] * lengths[:, None], mail, n_mails) / np.maximum(total, 1)[:, None]
        return posterior, lengths, mail, share, float((np.log(weight) + top - self.bar).sum())


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, words of each sentence, and the row of each sentence."""
    lengths = batch.column("lengths")
    mail = np.repeat(np.arange(batch.num_rows), np.diff(lengths.offsets.to_numpy()))
    return batch.column("words").flatten().to_numpy(), lengths.flatten().to_numpy(), mail


def _by_mail(values: np.ndarray, mail: np.ndarray, n_mails: int) -> np.ndarray:
    return np.stack([np.bincount(mail, weights=column, minlength=n_mails) for column in values.T], 1)


def encoded_mails(documents: DataFrame, key: str, text: str, *, sender: str | None, lang: str | None, buckets: int) -> Written:
    """``key, sender, lang, lengths, notice_a, notice_b, words``: running text as word buckets, sentence by sentence.

    Each mail is read whole and parsed once; what follows works on this table only.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            lengths, numbers, marks = [], [], ([], [])
            for raw in batch.column(3).to_pylist():
                sentences = running_sentences(raw)
                lengths.append([len(s) for s, _ in sentences])
                for i, of in enumerate(marks):
                    of.append([m[i] for _, m in sentences])
                numbers.append([known[w] if w in known else known.setdefault(w, zlib.crc32(w.encode("utf-8", "replace")) % buckets) for s, _ in sentences for w in s])
            if len(known) > 1_000_000:
                known.clear()
            lists = [pa.array(c, pa.list_(pa.int32())) for c in (lengths, *marks, numbers)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["key", "sender", "lang", "lengths", "notice_a", "notice_b", "words"])

    given = spread(documents.select(
        F.col(key).alias("key"), F.coalesce(*[F.col(c).cast("string") for c in (sender, key) if c]).alias("sender"),
        (F.lower(F.trim(lang)) if lang else F.lit(None).cast("string")).alias("lang"), F.col(text).cast("string").alias("text"),
    ))
    lists = ", ".join(f"{c} array<int>" for c in ("lengths", "notice_a", "notice_b", "words"))
    return Written(given.mapInArrow(encode, f"key {dict(given.dtypes)['key']}, sender string, lang string, {lists}"))


def shared_marks(encoded: DataFrame) -> np.ndarray:
    """The marks of paragraphs that the mails of ``LEAST_SENDERS`` or more senders have; their number is bounded by ``MARKS``."""
    marks = encoded.where(F.exists("notice_a", lambda m: m > 0)).select("sender", F.explode(F.array_distinct(F.concat("notice_a", "notice_b"))).alias("mark"))
    senders = marks.where("mark > 0").distinct().groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    return senders.where(F.col("n") >= LEAST_SENDERS).select("mark").toArrow()["mark"].to_numpy()


def language_model(encoded: DataFrame, buckets: int) -> np.ndarray:
    """Per language and bucket, log P(word), with one language where mails have none: naive Bayes trained on the given languages.

    Given languages may be missing or wrong; a mail's language is the likeliest one by all of its words.
    """
    given = encoded.where("lang is not null and lang <> ''").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = given.agg(F.sum("n")).first()[0] or 0
    names = [r["lang"] for r in given.where(F.col("n") >= max(1.0, LEAST_LANGUAGE * total)).orderBy("lang").collect()]
    if len(names) < 2:
        return np.zeros((1, buckets), np.float32)
    number = F.coalesce(*[F.when(F.col("lang") == name, F.lit(i)) for i, name in enumerate(names)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(names) * buckets, np.int64)
        for batch in batches:
            words = batch.column("words")
            of = np.repeat(batch.column("language").to_numpy(), np.diff(words.offsets.to_numpy()))
            counts += np.bincount(of.astype(np.int64) * buckets + words.flatten().to_numpy(), minlength=len(counts))
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], ["slot", "n"])

    known = encoded.select(number.alias("language"), "words").where("language is not null")
    summed = known.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # languages times buckets at most
    counts = np.zeros(len(names) * buckets)
    counts[summed["slot"].to_numpy()] = summed["n"].to_numpy()
    counts = counts.reshape(len(names), buckets) + SMOOTHING
    return np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def prepared_mails(encoded: DataFrame, known: DataFrame, languages: np.ndarray, notices: np.ndarray) -> DataFrame:
    """``key, named, language, lengths, words``: mails without notices, with their language and, where labelled, their subjects."""
    kind = dict(encoded.dtypes)["key"]
    shared = encoded.sparkSession.sparkContext.broadcast((languages, notices))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p, marks = shared.value
        for batch in batches:
            words, lengths, mail = _flat(batch)
            kept = ~(np.isin(batch.column("notice_a").flatten().to_numpy(), marks) | np.isin(batch.column("notice_b").flatten().to_numpy(), marks))
            words, of_word = words[np.repeat(kept, lengths)], np.repeat(mail[kept], lengths[kept])
            score = np.stack([np.bincount(of_word, weights=row[words], minlength=batch.num_rows) for row in log_p], 1)
            lists = []
            for values, owner in ((lengths[kept], mail[kept]), (words, of_word)):
                offsets = np.r_[0, np.cumsum(np.bincount(owner, minlength=batch.num_rows))]
                lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("named"), pa.array(score.argmax(1), pa.int32()), *lists], ["key", "named", "language", "lengths", "words"]
            )

    given = encoded.select("key", "lengths", "notice_a", "notice_b", "words").join(known, "key", "left")
    return written(given.mapInArrow(prepare, f"key {kind}, named array<int>, language int, lengths array<int>, words array<int>"))


def clean_labels(labels: DataFrame, subjects: list[str], *, key: str, subject: str, most: int = MOST_LABELLED) -> DataFrame:
    """``key, named``: the subject numbers of each labelled mail, empty for none.

    Spelling, blanks and repeated rows do not matter; nulls and unknown subjects are no labels. A mail labelled both
    with a subject and as none has the subject.
    """
    name = F.lower(F.regexp_replace(F.col(subject), r"^\s+|\s+$", ""))
    number = F.coalesce(*[F.when(name == s.lower(), F.lit(i)) for i, s in enumerate(subjects)], F.when(name == "none", F.lit(-1)))
    valid = labels.select(F.col(key).alias("key"), number.alias("number")).where("key is not null and number is not null")
    grouped = valid.groupBy("key").agg(F.array_sort(F.collect_set("number")).alias("all"))  # at most one entry per subject
    return grouped.select("key", F.filter("all", lambda n: n >= 0).alias("named")).orderBy(F.xxhash64("key"), "key").limit(most)


def _summed(partial: DataFrame, shape: tuple[int, int], n_subjects: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected words by (language, bucket, subject), all words by (language, bucket), and the log likelihood."""
    rows = partial.groupBy("language", "bucket").agg(
        F.sum("total").alias("total"), *[F.sum(F.col("by_subject")[i]).alias(f"s{i}") for i in range(n_subjects)]
    ).toArrow()
    by_subject, total = np.zeros((*shape, n_subjects), np.float32), np.zeros(shape, np.float32)
    is_count = rows["language"].to_numpy() >= 0
    likelihood = float(rows["total"].to_numpy()[~is_count].sum())
    at = rows["language"].to_numpy()[is_count], rows["bucket"].to_numpy()[is_count]
    total[at] = rows["total"].to_numpy()[is_count]
    for i in range(n_subjects):
        by_subject[(*at, i)] = rows[f"s{i}"].to_numpy()[is_count]
    return by_subject, total, likelihood


def _emitted(by_subject: np.ndarray, total: np.ndarray, likelihood: float) -> Iterator[pa.RecordBatch]:
    """The counts that are not 0; the log likelihood as the total of language -1."""
    language, bucket = np.nonzero(total)
    expected = np.r_[by_subject[language, bucket], np.zeros((1, by_subject.shape[2]))].astype(np.float64)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[language, -1].astype(np.int32)), pa.array(np.r_[bucket, 0].astype(np.int32)),
            pa.array(np.r_[total[language, bucket], likelihood].astype(np.float64)), pa.array(list(expected), pa.list_(pa.float64())),
        ],
        ["language", "bucket", "total", "by_subject"],
    )


COUNTS = "language int, bucket int, total double, by_subject array<double>"


def _expected(mails: DataFrame, shape: tuple[int, int], n_subjects: int, model=None) -> DataFrame:
    """Expected word counts of each partition: from labels (column ``named``), or from the posteriors of ``model``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_subject, total, likelihood = np.zeros((shape[0] * shape[1], n_subjects), np.float32), np.zeros(shape[0] * shape[1], np.float32), 0.0
        for batch in batches:
            words, lengths, mail = _flat(batch)
            if not len(words):
                continue
            if model is None:
                given = np.zeros((batch.num_rows, n_subjects))
                for row, named in enumerate(batch.column("named").to_pylist()):
                    given[row, named] = 1 / max(len(named), 1)
                of_sentence = given[mail]
            else:
                judged = model.value.posteriors(batch)
                of_sentence, likelihood = judged[0][:, :-1], likelihood + judged[4]
            slot = np.repeat(batch.column("language").to_numpy()[mail], lengths) * shape[1] + words
            used, place = np.unique(slot, return_inverse=True)
            sentence = np.repeat(np.arange(len(lengths)), lengths)
            total[used] += np.bincount(place)
            for i in range(n_subjects):
                by_subject[used, i] += np.bincount(place, weights=of_sentence[sentence, i])
        yield from _emitted(by_subject.reshape(*shape, n_subjects), total.reshape(shape), likelihood)

    return mails.mapInArrow(count, COUNTS)


def _complement_weights(by_subject: np.ndarray, total: np.ndarray) -> np.ndarray:
    """log P(word) - log P(word | complement of the subject), smoothed, by language; 0 for words never seen."""
    vocabulary = np.maximum((total > 0).sum(1), 1)[:, None]
    seen = (total + SMOOTHING) / (total.sum(1, keepdims=True) + SMOOTHING * vocabulary)
    rest = total[:, :, None] - by_subject
    np.maximum(rest, 0, out=rest)
    rest = (rest + SMOOTHING) / (rest.sum(1, keepdims=True) + SMOOTHING * vocabulary[:, :, None])
    weights = np.log(seen)[:, :, None] - np.log(rest)
    weights[total == 0] = 0
    return weights.astype(np.float32)


def _calibrated(share: np.ndarray, named: np.ndarray, quarter: float) -> tuple[np.ndarray, np.ndarray]:
    """Slope and offset of each subject's posterior, a logistic function of the logit of its share.

    Fitted on labelled mails, one subject independently of another. A prior holds the fit where ``quarter``, the
    share by which the subject is defined, gives one half; so a few wrong labels do not move the bound.
    """
    slopes, offsets = [], []
    x_all = _logit(share) - _logit(np.array(quarter))
    for x, y in zip(x_all.T, named.T, strict=True):
        a, b = 2.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = p * (1 - p)
            gradient = np.array([((y - p) * x).sum() - 4 * (a - 2), (y - p).sum() - b / 0.01])
            curvature = np.array([[(w * x * x).sum() + 4, (w * x).sum()], [(w * x).sum(), w.sum() + 1 / 0.01]])
            step = np.linalg.solve(curvature, gradient)
            a, b = max(0.5, a + float(np.clip(step[0], -1, 1))), b + float(np.clip(step[1], -1, 1))
        slopes.append(a)
        offsets.append(b)
    return np.array(slopes), np.array(offsets)


def _logit(share: np.ndarray) -> np.ndarray:
    bounded = np.clip(share, 0.001, 0.999)
    return np.log(bounded) - np.log1p(-bounded)


def subject_posteriors(
    documents: DataFrame, labels: DataFrame, subjects: list[str], *, key: str = "doc_id", text: str = "text",
    subject: str = "subject", sender: str | None = None, lang: str | None = None, quarter: float = 0.25, most_labelled: int = MOST_LABELLED,
) -> DataFrame:
    """``<key>, subject, share, posterior`` for every mail and subject of which its running text has a share of words.

    A sentence's subject is judged by complement naive Bayes: for each word, how much less probable it is where the
    subject is not. The first model is trained on the labelled mails (a bounded sample, ``most_labelled``). Then
    expectation-maximization over the sentences of all mails without a label, until their likelihood grows no more: posteriors of
    sentences, given the mixture of subjects in their mail, give expected word counts, and these, with those of the labelled
    mails, the next model. The counts cover all mails and are gathered per (language, word bucket), of which there is a fixed
    number. At last each subject's posterior that at least a ``quarter`` of a mail is about it is calibrated independently on the
    labelled mails.

    ``lang`` names a column with the language, which may be null or wrong: it trains a model that tells each mail's language.
    ``sender`` names one with the sender (the key, where it is null), by which notices are told from running text. Null, empty and
    wordless texts and mails about nothing give no rows; repeated mails give repeated rows; without any label, or any subject,
    there are no rows.
    """
    spark = documents.sparkSession
    kind = dict(documents.dtypes)[key]
    n = len(subjects)
    nothing = spark.createDataFrame([], f"`{key}` {kind}, subject string, share double, posterior double")
    if not n:
        return nothing
    buckets = min(BUCKETS, 1 << max(8, (MOST_WEIGHTS // (3 * n)).bit_length() - 1))
    known = clean_labels(labels, subjects, key=key, subject=subject, most=most_labelled)
    encoded = encoded_mails(documents, key, text, sender=sender, lang=lang, buckets=buckets)
    languages = language_model(encoded.df, buckets)
    shape = (len(languages), buckets)
    # no more labels than MOST_LABELLED, of an id and a few numbers each: about 10 MB
    mails = prepared_mails(encoded.df, F.broadcast(known) if most_labelled <= MOST_LABELLED else known, languages, shared_marks(encoded.df))
    encoded.drop()
    labelled, others = mails.where("named is not null"), mails.where("named is null")
    first_counts, first_total, _ = _summed(_expected(labelled, shape, n), shape, n)
    if not first_counts.any():
        return nothing
    mean = np.full(n + 1, 1 / (n + 1))
    shared = spark.sparkContext.broadcast(Model(_complement_weights(first_counts, first_total), mean, BARS[0]))
    before, reached, step = None, None, 1
    while True:
        by_subject, total, likelihood = _summed(_expected(others, shape, n, shared), shape, n)
        if step >= len(BARS) and not likelihood > reached + LEAST_GAIN * abs(reached):
            if likelihood < reached:  # the model before was better
                shared, before = before, shared
            before.unpersist()
            break
        by_subject, total = by_subject + first_counts, total + first_total
        about = by_subject.sum((0, 1)) / max(float(total.sum()), 1.0)
        mean = np.r_[about, max(1 - about.sum(), 0.001)]
        if before is not None:
            before.unpersist()
        before, reached = shared, likelihood
        shared = spark.sparkContext.broadcast(Model(_complement_weights(by_subject, total), mean / mean.sum(), BARS[min(step, len(BARS) - 1)]))
        step += 1

    judged = labelled.mapInArrow(_shares(shared), "key string, share array<double>, named array<int>").toArrow()
    share = np.array(judged["share"].to_pylist(), float).reshape(-1, n)
    named = np.zeros_like(share)
    for row, numbers in enumerate(judged["named"].to_pylist()):
        named[row, numbers] = 1
    slopes, offsets = _calibrated(share, named, quarter)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value.posteriors(batch)[3]
            posterior = 1 / (1 + np.exp(-np.clip(slopes * (_logit(own) - _logit(np.array(quarter))) + offsets, -30, 30)))
            mail, which = np.nonzero(own >= 0.01)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(mail)), pa.array([subjects[i] for i in which], pa.string()),
                 pa.array(own[mail, which]), pa.array(posterior[mail, which])],
                [key, "subject", "share", "posterior"],
            )

    return mails.mapInArrow(judge, f"`{key}` {kind}, subject string, share double, posterior double")


def _shares(model):
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = model.value.posteriors(batch)[3]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").cast(pa.string()), pa.array(list(own), pa.list_(pa.float64())), batch.column("named")], ["key", "share", "named"]
            )

    return share
