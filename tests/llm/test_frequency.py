from collections import Counter, defaultdict

from pyspark.sql import functions as F
from tests.helpers import rows

from tallyloom.llm.frequency import marked, term_frequencies

SCHEMA = "w string, doc int, term string, record int, n int"


def table(spark, data, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in data], SCHEMA).repartition(parts)


def brute(data):
    n, records = Counter(), defaultdict(set)
    for w, d in data:
        if w is not None and d is not None:
            n[w] += 1
            records[w].add(d)
    return sorted((w, n[w], len(records[w])) for w in n)


def test_against_brute_force(spark, rng):
    data = [(rng.choice(["hot", "hot", "", *"abcdefg", "x" * 20_000]), rng.randrange(25)) for _ in range(3000)] + [(None, 1), ("a", None)]
    assert rows(term_frequencies(table(spark, data), "w", "doc")) == brute(data)


def test_runs_over_batches_and_partitions(spark, rng):
    """A hot term, and copies of a hot pair, that go on over many batches and partitions."""
    given = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in given}
    for name, value in given.items():
        spark.conf.set(name, value)
    try:
        for copies in (0, 300, 3000):
            data = [("hot", rng.randrange(200)) for _ in range(600)] + [("pair", 1)] * copies + [("b", 2), ("c", 3), ("hot", 7)]
            assert rows(term_frequencies(table(spark, data), "w", "doc")) == brute(data)
        ordered = table(spark, data).withColumn("salt", F.monotonically_increasing_id() % 64).repartitionByRange(4, "w", "doc", "salt")
        assert ordered.where("w = 'pair'").select(F.spark_partition_id()).distinct().count() > 1  # copies of one pair are spread
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_numbers_as_terms_and_empty(spark):
    numbers = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "w int, doc string")
    assert rows(term_frequencies(numbers, "w", "doc")) == [(1, 2, 1), (2, 1, 1)]
    assert term_frequencies(table(spark, []), "w", "doc").count() == 0


def test_marks(spark):
    counted = spark.createDataFrame([("a", 9, 2), ("b", 9, 3), ("c", 9, 10)], "term string, n_occurrences bigint, n_records bigint")
    assert rows(marked(counted, 1000, fewest=3), "term", "mark") == [("a", "rare"), ("b", None), ("c", "common")]
