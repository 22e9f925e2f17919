"""Queries against their SQL twins on the smallest given tables, and that every query keeps to the driver's contract."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CHOSEN = (
    "p1_found", "p4_found", "p4_per_key", "p6_found", "triplet_rows", "barcode_paths", "assign_documents", "count_levels", "last_k_trim", "unique_ratios",
    "overlap_pairs", "depth_histogram", "pearson_log2", "precision_recall_f1", "run_metrics", "matrix_entries", "normalised_cells", "streamed_counts", "paralog_groups",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


def plain(value):
    return ("nan" if math.isnan(value) else round(value, 6)) if isinstance(value, float) else value


def compared(spark, name, queries, sql):
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = connection.execute(sql[name])
    order = [[d[0] for d in found.description].index(c) for c in columns]
    want = sorted((repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall()))
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


@pytest.mark.parametrize("name", CHOSEN)
def test_query_is_its_sql(spark, name):
    compared(spark, name, entry.queries(), entry.oracle_sql())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["read_id", "status", "tx_id", "gene_id"]
