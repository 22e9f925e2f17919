import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import sequence as seq
from tallyloom.operators.index import minimizer_paths, path_triplets, posting_stats, postings, row_triplets
from tests.helpers import rows

# A 120-base transcript, and its minimizer paths for k-mers of 20 and minimizers of 8 and 7 bases.
TRANSCRIPT = "CTGGAGGAGGACGCATGCAAGGGAGAAAAGAATATTTCGCTGCCTGTTTGGAAATCTGAATTGGTTATTGAATATTATGTGTCTCTGATGCACAGGTCCTCCCCCACTTATGAATGTTGA"
PATH_8 = [7469, 4044, 194, 776, 2217, 8871, 10870, 23467, 620, 2480, 2810, 2210, 8843, 10427, 12006, 11539, 5093, 15961, 6700, 2988]
PATH_8_BASES = (
    "ACGCATGC AAGGGAGA AAAAGAAT AAAGAATA AATATTTC ATATTTCG ATTTCGCT CCTGTTTG AAATCTGA AATCTGAA AATTGGTT AATATTAT "
    "ATATTATG ATTATGTG ATGTGTCT ATGCACAG ACAGGTCC AGGTCCTC ACTTATGA AATGTTGA"
).split()


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column).first()[0]


def digits(text):
    return "".join(str((ord(c) >> 1) & 3) for c in text)


def brute_path(text, k, m):
    found = []
    code = digits(text)
    for i in range(len(code) - k + 1):
        v = min(int(code[j : j + m], 4) for j in range(i, i + k - m + 1))
        if not found or found[-1] != v:
            found.append(v)
    return found


def test_known_path(spark):
    df = spark.createDataFrame([("t", digits(TRANSCRIPT))], "id string, d string")
    assert minimizer_paths(df, "id", "d", 20, 8).first().path == PATH_8
    numbers = spark.createDataFrame([(v,) for v in PATH_8], "v bigint")
    assert [r[0] for r in numbers.select(seq.number_to_bases(F.col("v"), 8)).collect()] == PATH_8_BASES
    assert len(brute_path(TRANSCRIPT, 20, 7)) == 18


def test_codes(spark):
    assert one(spark, seq.encode_bases(F.lit("ACTGNacgtn"))) == "0123301323"
    assert one(spark, seq.digits_to_number(seq.encode_bases(F.lit("ACGCATGC")))) == 7469
    assert one(spark, seq.encode_letters(F.lit("Az-9 b"))) == "011"
    assert [(ord(c) >> 1) & 3 for c in seq.LETTERS] == [int(c) for c in seq.LETTER_CODES]


def test_paths_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 90))) for _ in range(60)] + [""]
    df = spark.createDataFrame([(i, digits(t), 1) for i, t in enumerate(texts)] + [(99, None, 1)], "id int, d string, path int")
    got = {r.id: r.path for r in minimizer_paths(df, "id", "d", 12, 5).collect()}
    assert got == {**{i: brute_path(t, 12, 5) for i, t in enumerate(texts)}, 99: []}
    for k, m in ((5, 5), (5, 0), (32, 8)):
        with pytest.raises(ValueError):
            minimizer_paths(df, "id", "d", k, m)


def test_triplets_and_postings(spark):
    paths = spark.createDataFrame([("x", [1, 2, 3, 4]), ("y", [1, 2, 3]), ("z", [1, 2]), ("w", [])], "id string, path array<bigint>")
    triplets = path_triplets(paths, "id")
    assert rows(triplets) == [("x", 1, 1, 2, 3), ("x", 2, 2, 3, 4), ("y", 1, 1, 2, 3)]
    long = paths.select("id", F.posexplode("path").alias("pos", "v"))
    assert rows(row_triplets(long.union(long), "id", "pos", "v")) == rows(triplets)
    stats = posting_stats(postings(triplets, "id")).first()
    assert (stats.n_triplets, stats.mean_size, stats.median_size, stats.sd_size, stats.max_size) == (2, 1.5, 1.5, 0.5, 2)


def test_slices(spark):
    read = "A" * 27 + "C" * 16 + "GG"
    assert one(spark, seq.barcode_of(F.lit(read))) == "A" * 27 and one(spark, seq.umi_of(F.lit(read))) == "C" * 16
    assert one(spark, seq.umi_of(F.lit("ACGT"))) == "UNKNOWN" and one(spark, seq.barcode_of(F.lit(None).cast("string"))) == "UNKNOWN"
    assert one(spark, seq.tail(F.lit(TRANSCRIPT), 10)) == "TGAATGTTGA"
    assert one(spark, seq.tail(F.lit("AC"), 10)) == "AC" and one(spark, seq.tail(F.lit(None).cast("string"), 3)) == ""
    assert one(spark, seq.utr_tail(F.lit("AACCGG"), F.lit(1), 2)) == "CGG"
    assert one(spark, seq.reverse_complement(F.lit("AACGtN"))) == "NaCGTT"


def test_quality(spark):
    quality = "!I5+"
    scores = [ord(c) - 33 for c in quality]
    assert one(spark, seq.phred_scores(F.lit(quality))) == scores
    assert one(spark, seq.window_sums(seq.phred_scores(F.lit(quality)), 3)) == [sum(scores[i : i + 3]) for i in range(2)]
    assert one(spark, seq.window_sums(seq.phred_scores(F.lit(quality)), 4)) == [sum(scores)]
    assert one(spark, seq.window_sums(seq.phred_scores(F.lit(quality)), 5)) == []
    assert [one(spark, seq.kmer_flag(F.lit(k), F.lit(q), 2)) for k, q in (("AN", 99), ("AA", 37), ("AA", 38))] == ["unclear", "poor", "good"]
    assert one(spark, seq.kmers(F.lit("ACGT"), 3)) == ["ACG", "CGT"] and one(spark, seq.kmers(F.lit("AC"), 3)) == []
