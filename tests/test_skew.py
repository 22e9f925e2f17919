from collections import Counter

import pytest
from tests.helpers import rows

from tallyloom.operators.skew import at_least_share, heavy_groups, salted_aggregate

SCHEMA = "k string, m string, pos int, heavy int, salt int, key string, member string, value int"


def table(spark, data):
    return spark.createDataFrame([(*r, 1, 1, "x", "y", 2) for r in data], SCHEMA)


@pytest.mark.parametrize("once", [False, True])
def test_salted_aggregate_against_brute_force(spark, rng, once):
    data = [("hot" if rng.random() < 0.4 else rng.choice("abcdefgh"), rng.choice([None, *"uvwxyz"]), rng.choice([None, *range(9)])) for _ in range(2000)]
    data += [(None, "u", 3), ("only_null", None, None)] + [("copied", "u", 4)] * 1200  # a third of all rows are copies of one
    got = salted_aggregate(table(spark, data).repartition(3), "k", member="m", lowest_highest="pos", once=once, share=0.05, salts=5, looked_at=1.0)
    want = []
    for key in {k for k, _, _ in data if k is not None}:
        own = [(m, p) for k, m, p in data if k == key]
        own = list(set(own)) if once else own
        pos = [p for _, p in own if p is not None]
        want.append((key, len(own), len({m for m, _ in own if m is not None}), min(pos, default=None), max(pos, default=None)))
    assert rows(got, "k", "n_rows", "n_members", "lowest", "highest") == sorted(want)


def test_what_is_looked_at_changes_nothing(spark, rng):
    data = [("hot" if rng.random() < 0.4 else rng.choice("abcdefgh"), rng.choice("uvwxyz"), rng.choice(range(9))) for _ in range(500)]
    found = [rows(salted_aggregate(table(spark, data), "k", member="m", lowest_highest="pos", looked_at=share)) for share in (0.05, 1.0)]
    assert found[0] == found[1]


def test_heavy_groups_are_bounded(spark):
    data = [(k, m, 1) for k, m in zip("aaaaaaaabbbcd", "uuuuuuvwuvwuu", strict=True)]
    keys, pairs = heavy_groups(table(spark, data), "k", "m", share=0.2, looked_at=1.0)
    assert sorted(keys) == ["a", "b"] and pairs == [("a", "u")]


def test_hot_keys_are_spread(spark):
    """The shuffle by key and salt puts no more than a small part of a hot key into one partition."""
    from pyspark.sql import functions as F

    data = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").cast("string").alias("m"))
    plan = salted_aggregate(data, "k", member="m", looked_at=1.0)
    assert plan.first()["n_members"] == 20_000
    salted = data.withColumn("salt", F.pmod(F.xxhash64("m"), F.lit(64))).repartition(64, "k", "salt")
    assert salted.groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0] < 20_000 / 8


def test_share_and_empty(spark):
    counts = spark.createDataFrame(list(Counter("aaab").items()), "k string, n bigint")
    assert rows(at_least_share(counts, "n", 0.5), "k") == [("a",)]
    assert salted_aggregate(table(spark, []), "k", member="m").count() == 0
    assert salted_aggregate(table(spark, []), "k", member="m", once=True, looked_at=1.0).count() == 0
    assert at_least_share(counts.where("false"), "n", 0.5).count() == 0
