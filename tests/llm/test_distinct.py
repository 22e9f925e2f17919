from itertools import combinations

import numpy as np
import pytest
from tests.helpers import rows

from tallyloom.llm import distinct

SCHEMA = "day int, grp string, x string, y string, cell int, kind string, id string"
KINDS = {"x": ["x"], "xy": ["x", "y"]}


def table(spark, data):
    return spark.createDataFrame([(*r, 1, "k", "i") for r in data], SCHEMA).repartition(3)


def brute(data):
    found = {}
    for kind, of in (("x", lambda r: r[2]), ("xy", lambda r: r[2:4] if None not in r[2:4] else None)):
        for n in range(3):
            for subset in combinations((0, 1), n):
                for r in data:
                    if of(r) is not None:
                        key = (kind, "+".join(("day", "grp")[i] for i in subset) or "all", *[r[i] if i in subset else None for i in (0, 1)])
                        found.setdefault(key, set()).add(of(r))
    return {k: len(v) for k, v in found.items()}


def counts(df):
    return {tuple(r)[:4]: r.n_distinct for r in df.collect()}


def sample(rng, n):
    return [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None]), rng.choice([None, "", *map(str, range(60))]), rng.choice([None, "p", "q"])) for _ in range(n)]


def test_against_brute_force(spark, rng):
    data = sample(rng, 800)
    bitmaps = distinct.distinct_bitmaps(table(spark, data + data[:100]), ["day", "grp"], KINDS)
    assert counts(distinct.distinct_counts(bitmaps, ["day", "grp"])) == brute(data)


def test_bitmaps_of_separate_runs_merge(spark, rng, tmp_path):
    """Built day by day in separate calls with a kept dictionary, united, they equal one call; codes are never given twice."""
    data = sample(rng, 600)
    united = None
    for day in (2, 1, None, 3):
        kept = distinct.IdentifierDictionary(spark, list(KINDS), path=f"{tmp_path}/kept", shards=3)
        part = distinct.distinct_bitmaps(table(spark, [r for r in data if r[0] == day]), ["day", "grp"], KINDS, dictionary=kept)
        united = part if united is None else united.union(part)
    assert counts(distinct.distinct_counts(united, ["day", "grp"])) == brute(data)
    entries = kept.entries()
    assert entries.count() == entries.select("kind", "id").distinct().count() == entries.select("kind", "shard", "code").distinct().count()
    of = lambda day: {r[2] for r in data if r[0] == day and r[2] is not None}
    assert dict(rows(distinct.common_counts(united, "day = 1", "day = 2")))["x"] == len(of(1) & of(2))
    again = distinct.distinct_bitmaps(table(spark, data), ["day", "grp"], KINDS, dictionary=distinct.IdentifierDictionary(spark, ["x"], path=f"{tmp_path}/kept"))
    assert counts(distinct.distinct_counts(again.union(united), ["day", "grp"])) == brute(data) and kept.entries().count() == entries.count()


def test_a_dictionary_keeps_its_shards(spark, tmp_path):
    distinct.IdentifierDictionary(spark, ["x"], path=f"{tmp_path}/kept", shards=3)
    for wrong in ({"kinds": ["x"], "shards": 4}, {"kinds": ["y"]}):
        with pytest.raises(ValueError):
            distinct.IdentifierDictionary(spark, wrong["kinds"], path=f"{tmp_path}/kept", shards=wrong.get("shards"))


def test_many_cells_in_small_batches(spark, rng, monkeypatch):
    monkeypatch.setattr(distinct, "MOST_WAITING", 50)
    monkeypatch.setattr(distinct, "MOST_ROWS", 7)
    data = [(rng.randrange(500), rng.choice("abcdefghijkl"), str(rng.randrange(300)), "p") for _ in range(1500)]
    bitmaps = distinct.distinct_bitmaps(table(spark, data), ["day", "grp"], KINDS)
    assert counts(distinct.distinct_counts(bitmaps, ["day", "grp"])) == brute(data)


def test_or_of_groups(rng):
    sets = [set(rng.sample(range(distinct.BUCKET), rng.choice([0, 1, 3, 1500, 2500, 30_000]))) for _ in range(40)]
    group = np.array([rng.randrange(9) for _ in sets])
    group[:9] = range(9)
    group[:4] = range(9, 13)  # groups of a single bitmap
    group[4:13] = range(9)
    merged, n = distinct.or_groups([distinct.pack(np.array(sorted(s), np.int64)) for s in sets], group, 13)
    for g in range(13):
        want = set().union(*[s for s, own in zip(sets, group, strict=True) if own == g])
        assert set(np.flatnonzero(np.unpackbits(distinct.unpack(merged[g])))) == want and n[g] == len(want)


def test_common_identifiers(spark, rng):
    data = sample(rng, 300)
    bitmaps = distinct.distinct_bitmaps(table(spark, data), ["day", "grp"], KINDS)
    of = lambda day: {r[2] for r in data if r[0] == day and r[2] is not None}
    got = dict(rows(distinct.common_counts(bitmaps, "day = 1", "day = 2")))
    assert got["x"] == len(of(1) & of(2))


def test_several_buckets(spark):
    own = spark.range(300_000).selectExpr("int(1 + id % 2) as day", "concat('id', id) as x")
    again = spark.range(1000).where("id % 2 = 1").selectExpr("1 as day", "concat('id', id) as x")
    bitmaps = distinct.distinct_bitmaps(own.union(again), ["day"], {"x": ["x"]})
    assert bitmaps.agg({"bucket": "max"}).first()[0] >= 1
    assert counts4(distinct.distinct_counts(bitmaps, ["day"])) == {("day", 1): 150_500, ("day", 2): 150_000, ("all", None): 300_000}


def counts4(df):
    return {(r.by, r.day): r.n_distinct for r in df.collect()}


def test_packing_round_trip(rng):
    for n in (1, 5, distinct.FEW - 1, distinct.FEW, 20_000, distinct.BUCKET):
        positions = np.array(rng.sample(range(distinct.BUCKET), n))
        packed = distinct.pack(positions)
        assert len(packed) <= distinct.BUCKET // 8
        bits = np.unpackbits(distinct.unpack(packed))
        assert set(np.flatnonzero(bits)) == set(positions)


def test_empty(spark):
    bitmaps = distinct.distinct_bitmaps(table(spark, []), ["day", "grp"], KINDS)
    assert bitmaps.count() == 0 and distinct.distinct_counts(bitmaps, ["day", "grp"]).count() == 0
