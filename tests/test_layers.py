import pytest

import __spark_entry__ as entry
from tallyloom.operators import annotation
from tallyloom.operators.layers import touches_by_layer
from tests.helpers import rows

SPANS, READS = "c string, s int, e int, first int, last int", "c2 string, s2 int, e2 int"
ON = {"spans_on": ("c", "s", "e"), "reads_on": ("c2", "s2", "e2"), "first": "first", "last": "last"}


def brute(spans, reads, n_layers):
    found = {}
    for layer in range(n_layers):
        for chrom in {x[0] for x in spans if x[0] is not None}:
            merged = []
            for s, e in sorted((s, e) for c, s, e, first, last in spans if c == chrom and None not in (s, e) and e > s and first <= layer <= last):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            n = sum(s < b and a < e for c, s, e in reads if c == chrom and None not in (s, e) and e > s for a, b in merged)
            if n:
                found[chrom, layer] = n
    return sorted((*k, n) for k, n in found.items())


@pytest.fixture
def small_batches(spark):
    name, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("width", [7, 64, 1_048_576])
def test_touches_against_brute_force(spark, rng, small_batches, width):
    spans = [(rng.choice("aab"), s := rng.randrange(-60, 700), s + rng.randrange(-2, 25), first := rng.randrange(4), rng.randrange(first, 4)) for _ in range(90)]
    spans += spans[:9] + [("a", 100, 300, 2, 2), ("a", 300, 301, 2, 3), ("d", 0, 70, 0, 3), ("d", 70, 77, 0, 1), (None, 1, 5, 0, 3), ("a", None, 5, 0, 3), ("e", 1, 5, 0, 0)]
    reads = [(rng.choice("aabd"), s := rng.randrange(-80, 720), s + rng.randrange(-2, 60)) for _ in range(80)]
    reads += reads[:9] + [("a", -500, 900), ("d", 77, 90), ("d", -3, 0), ("f", 1, 9), (None, 1, 9), ("b", 3, None), ("b", 9, 9)]
    got = touches_by_layer(spark.createDataFrame(spans, SPANS), spark.createDataFrame(reads, READS), n_layers=4, slice_width=width, **ON)
    assert rows(got) == brute(spans, reads, 4)


def test_no_spans_or_no_reads(spark):
    spans, reads = spark.createDataFrame([("a", 1, 5, 0, 1)], SPANS), spark.createDataFrame([("a", 1, 5)], READS)
    assert rows(touches_by_layer(spans, reads, n_layers=2, **ON)) == [("a", 0, 1), ("a", 1, 1)]
    assert rows(touches_by_layer(spans.limit(0), reads, n_layers=2, **ON)) == rows(touches_by_layer(spans, reads.limit(0), n_layers=2, **ON)) == []


def test_runs_of_cutoffs_are_the_cutoffs(spark, rng):
    schema = "transcript_id string, gene_id string, chrom string, is_negative boolean, utr_len int, exons array<struct<exon_start: int, exon_end: int>>"
    exons = lambda: [(s := rng.randrange(1, 900), s + rng.randrange(-1, 90)) for _ in range(rng.randrange(0, 5))]
    given = spark.createDataFrame([(f"t{i}", "g", "c", rng.choice([True, False, None]), rng.choice([None, 0, 7, 60, -30]), exons()) for i in range(40)], schema)
    cutoffs, place = [10, 25, 60, 100, 1000], ("transcript_id", "exon_start", "exon_end", "width", "number")
    want = rows(annotation.at_cutoffs(given, cutoffs), "cutoff", *place)
    runs = annotation.at_cutoff_runs(given, cutoffs).select("first", "last", *place).collect()
    assert sorted((cutoffs[i], *r[2:]) for r in runs for i in range(r["first"], r["last"] + 1)) == want
    assert len(runs) < len(want)


def test_coverage_by_cutoff_sends_no_exploded_rows_to_the_driver(spark):
    """Rows of a table after an explode are many more than the planner estimates; it would broadcast them from the driver."""
    plan = entry.queries()["coverage_by_cutoff"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
