from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyloom.operators.intervals import best_overlap, depth_segments, merged_loci, overlap_join, periods_and_gaps
from tests.helpers import rows

SCHEMA = "chrom string, s int, e int, entity string, slice string, start int, kind string"


def table(spark, data):
    return spark.createDataFrame([(*row, "x", "y", 1, "z") for row in data], SCHEMA)


def brute(data, touching=True):
    found = []
    for chrom in {c for c, s, e in data if c is not None}:
        iv = sorted((s, e) for c, s, e in data if c == chrom and s is not None and e is not None and e > s)
        merged = []
        for s, e in iv:
            if merged and (s <= merged[-1][1] if touching else s < merged[-1][1]):
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        found += [(chrom, "period", s, e) for s, e in merged]
        found += [(chrom, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False) if a[1] < b[0]]
    return sorted(found)


def test_periods_against_brute_force(spark, rng):
    data = [(rng.choice("aab"), s := rng.randrange(0, 3000), s + rng.randrange(-2, 40)) for _ in range(400)]
    data += data[:30] + [(None, 1, 5), ("a", None, 5), ("a", 5, None), ("a", 9, 9), ("c", 0, 2500), ("c", 100, 200)]
    for width in (7, 100, 65_536):
        for touching in (True, False):
            got = periods_and_gaps(table(spark, data), "chrom", "s", "e", slice_width=width, touching=touching)
            assert rows(got, "entity", "kind", "from_pos", "to_pos") == brute(data, touching)


def test_period_numbers_are_successive(spark, rng):
    data = [("a", s := rng.randrange(0, 5000), s + 3) for _ in range(200)]
    got = periods_and_gaps(table(spark, data), "chrom", "s", "e", slice_width=50).where("kind = 'period'").orderBy("from_pos").collect()
    assert [r.number for r in got] == list(range(1, len(got) + 1))


def test_empty_table(spark):
    assert periods_and_gaps(table(spark, []), "chrom", "s", "e").count() == 0


def test_negative_positions(spark):
    got = periods_and_gaps(table(spark, [("a", -10, -5), ("a", -5, 3), ("a", 7, 9)]), "chrom", "s", "e", slice_width=4)
    assert rows(got, "kind", "from_pos", "to_pos") == [("gap", 3, 7), ("period", -10, 3), ("period", 7, 9)]


def test_overlap_join_against_brute_force(spark, rng):
    left = [(i, rng.choice("ab"), s := rng.randrange(0, 500), s + rng.randrange(1, 90)) for i in range(60)] + [(60, None, 1, 2), (61, "a", None, 5)]
    right = [(i, rng.choice("ab"), s := rng.randrange(0, 500), s + rng.randrange(1, 90)) for i in range(60)]
    a = spark.createDataFrame(left, "id int, c string, s int, e int")
    b = spark.createDataFrame(right, "id2 int, c2 string, s2 int, e2 int")
    want = sorted((x[0], y[0]) for x in left for y in right if None not in x and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    on = {"left_on": ("c", "s", "e"), "right_on": ("c2", "s2", "e2"), "bin_width": 16}
    assert rows(overlap_join(a, b, **on), "id", "id2") == want
    lonely = {x[0] for x in left} - {x for x, _ in want}
    assert {r[0] for r in rows(overlap_join(a, b, how="left", **on).where("id2 is null"), "id")} == lonely


def test_best_overlap_takes_the_most_and_breaks_ties_by_id(spark):
    a = spark.createDataFrame([(1, "a", 10, 20)], "id int, c string, s int, e int")
    b = spark.createDataFrame([(7, "a", 15, 30), (5, "a", 5, 15), (3, "a", 19, 40)], "id2 int, c2 string, s2 int, e2 int")
    got = best_overlap(a, b, left_id="id", right_id="id2", left_on=("c", "s", "e"), right_on=("c2", "s2", "e2"))
    assert rows(got) == [(1, 5, 5)]


def test_depth_against_brute_force(spark, rng):
    data = [(rng.choice("ab"), s := rng.randrange(0, 300), s + rng.randrange(0, 40)) for _ in range(120)] + [(None, 1, 2), ("a", None, 2)]
    for width in (5, 1000):
        got = depth_segments(table(spark, data), "chrom", "s", "e", slice_width=width)
        depth = {}
        for chrom, a, b, n in rows(got, "entity", "from_pos", "to_pos", "depth"):
            assert a < b
            depth.update({(chrom, p): n for p in range(a, b)})
        want = {}
        for chrom, s, e in data:
            if None not in (chrom, s, e):
                for p in range(s, e):
                    want[chrom, p] = want.get((chrom, p), 0) + 1
        assert depth == want
    assert depth_segments(table(spark, []), "chrom", "s", "e").count() == 0


def test_padded_loci(spark):
    got = merged_loci(table(spark, [("a", 0, 10), ("a", 14, 20), ("a", 26, 30), (None, 1, 2)]), "chrom", "s", "e", padding=5)
    assert rows(got) == [("a", 0, 20, 2), ("a", 26, 30, 1)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-50, 50), st.integers(-50, 60)), max_size=25))
def test_any_intervals(spark, data):
    got = periods_and_gaps(table(spark, data), "chrom", "s", "e", slice_width=8)
    assert rows(got, "entity", "kind", "from_pos", "to_pos") == brute(data)
