"""Differences of keys that have several versions, against the SQL of the query."""

import duckdb

import __spark_entry__ as entry
from tests.helpers import rows


def test_keys_with_several_versions(spark, tmp_path):
    one = [("r", "kept", 1, 1.0, "g"), ("r", "one", 1, 1.0, "g"), ("r", "two", 1, 1.0, "g"), ("r", "two", 2, 1.0, "g"), ("r", "null", None, None, "g"), ("r", "only", 1, 1.0, "g")]
    two = [
        ("r", "kept", 1, 1.0, "g"), ("r", "kept", 3, 1.0, "g"), ("r", "one", 1, 1.5, "g"), ("r", "one", 1, 1.0, "h"), ("r", "two", 1, 1.0, "g"), ("r", "two", 2, 2.0, "g"),
        ("r", "null", 1, None, "g"), ("r", "null", None, 2.0, "g"), ("r", "new", 1, 1.0, "g"), ("r", "new", 2, 1.0, "g"),
    ]
    connection = duckdb.connect()
    for name, given in (("counts", one), ("counts_copy", two)):
        wide = [(run, key, n, cpm, level, "gene") for run, key, n, cpm, level in given]
        spark.createDataFrame(wide, "run string, id string, count bigint, cpm double, id_level string, gene_id string").write.parquet(f"{tmp_path}/{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = rows(entry.queries()["p6_found"](spark, str(tmp_path)), "run", "id", "difference")
    assert found == sorted(set(connection.execute(entry.oracle_sql()["p6_found"]).fetchall()))
    assert ("r", "KEPT", "count") in found and ("r", "KEPT", "missing_in_counts") not in found
