"""Queries that take in all rows of their tables, on small tables made here and against their SQL twins."""

import pytest

import __spark_entry__ as entry
from tallyloom.operators.intervals import neighbours
from tests.helpers import rows
from tests.test_queries import compared, pytestmark  # noqa: F401


def table(spark, folder, name, given, schema):
    spark.createDataFrame(given, schema).write.parquet(f"{folder}/{name}.parquet")


def test_neighbours_over_slice_borders(spark):
    given = [("c", 5, "g1"), ("c", 9, "g1"), ("c", 5, "g0"), ("c", 12, "g2"), ("c", 95, "g3"), ("d", 1, "g1"), ("d", 300, "g4"), ("c", None, "g5"), (None, 1, "g6")]
    df = spark.createDataFrame(given, "chrom string, start int, gene string")
    want = [("c", "g0", "g1"), ("c", "g1", "g2"), ("c", "g2", "g3"), ("d", "g1", "g4")]
    assert rows(neighbours(df, "chrom", "start", "gene", slice_width=10)) == want == rows(neighbours(df, "chrom", "start", "gene"))


def test_gene_neighbours_take_all_positions(spark, tmp_path):
    genes = [f"MQG00000000{i}" for i in range(1, 5)]
    starts = [10, 49_990, 50_010, 200_000]
    table(spark, tmp_path, "transcripts", [(f"T{g}", g, "c", s) for g, s in zip(genes, starts, strict=True)], "transcript_id string, gene_id string, chrom string, tx_start int")
    paths = [(genes[0], 0, "AA"), (genes[0], 3, "GG"), (genes[1], 0, "CC"), (genes[1], 2, "gg"), (genes[2], 0, "TT"), (genes[3], 1, "GG")]
    table(spark, tmp_path, "minimizer_paths", [(f"T{g}", pos, m) for g, pos, m in paths], "tx_id string, pos int, minimizer string")
    table(spark, tmp_path, "paralogs", [(genes[2], genes[1].lower() + ".1")], "gene string, paralogs string")
    found = entry.queries()["gene_neighbours"](spark, str(tmp_path))
    assert rows(found, "left", "right", "linked", "shares") == [(genes[0], genes[1], False, True), (genes[1], genes[2], True, False), (genes[2], genes[3], False, False)]


def test_lane_differences_take_all_lanes(spark, tmp_path):
    table(spark, tmp_path, "barcode_umi", [("A", 1), ("a", 2), ("A", 3), ("B", 4), ("C", 4), ("C", 3), (None, 1)], "barcode string, lane int")
    found = rows(entry.queries()["lane_differences"](spark, str(tmp_path)), "barcode", "lane", "missing_on")
    assert found == [("A", 1, 4), ("A", 2, 4), ("A", 3, 4), ("B", 4, 1), ("B", 4, 2), ("B", 4, 3), ("C", 3, 1), ("C", 3, 2), ("C", 4, 1), ("C", 4, 2)]


def test_linked_neighbours_keep_to_a_strand(spark, tmp_path):
    genes = [f"MQG00000000{i}" for i in range(1, 5)]
    given = [(f"T{g}", g, "c", 10 * i, minus) for i, (g, minus) in enumerate(zip(genes, (False, True, None, True), strict=True))]
    table(spark, tmp_path, "transcripts", given, "transcript_id string, gene_id string, chrom string, tx_start int, is_negative boolean")
    table(spark, tmp_path, "minimizer_paths", [(f"T{genes[1]}", 4, "AC"), (f"T{genes[3]}", 9, "ac")], "tx_id string, pos int, minimizer string")
    table(spark, tmp_path, "paralogs", [(genes[0], genes[2])], "gene string, paralogs string")
    found = entry.queries()["linked_neighbours"](spark, str(tmp_path))
    assert rows(found, "strand", "left", "right", "linked", "shares") == [("c+", genes[0], genes[2], True, False), ("c-", genes[1], genes[3], False, True)]


def test_unmatched_reads_take_all_lanes(spark, tmp_path):
    table(spark, tmp_path, "barcode_umi", [("A", 1), ("a", 3), ("B", 4), ("b", 4), (None, 1), ("C", None)], "barcode string, lane int")
    assert rows(entry.queries()["unmatched_reads"](spark, str(tmp_path)), "barcode", "side") == [("B", "lane_4")]


def test_coverage_and_ratios_take_all_cutoffs(spark, tmp_path):
    schema = "transcript_id string, gene_id string, chrom string, is_negative boolean, utr_len int, exons array<struct<exon_start: int, exon_end: int>>"
    table(spark, tmp_path, "transcripts", [("t1", "g", "c", False, 0, [(1, 3000)]), ("t2", "g", "c", False, 0, [(5001, 5050)])], schema)
    bed = [("c", 2890, 2900, "only beyond 100", "+"), ("c", 2950, 2960, "at all", "+"), ("c", 2950, 2960, "at all, too", "+")]
    table(spark, tmp_path, "bed_entries", bed, "chrom string, chromstart int, chromend int, name string, strand string")
    found = rows(entry.queries()["coverage_by_interval"](spark, str(tmp_path)), "cutoff", "chrom", "from_pos", "to_pos", "n_hits")
    first = [(k, "c", 3000 - k, 3000, 2 if k == 100 else 3) for k in range(100, 2001, 100)]
    assert found == sorted([*first, *((k, "c", 5000, 5050, 0) for k in range(100, 2001, 100))])
    ratios = entry.queries()["unique_ratios"](spark, str(tmp_path))
    assert set(range(100, 1001, 100)) <= {r.cutoff for r in ratios.collect()}


@pytest.mark.parametrize("name", ["gene_neighbours", "linked_neighbours", "unmatched_reads", "lane_differences", "coverage_by_cutoff", "coverage_by_interval"])
def test_query_is_its_sql(spark, name):
    compared(spark, name, entry.queries(), entry.oracle_sql())
