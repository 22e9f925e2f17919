"""Queries of the general numbered problems over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.compare import table_differences
from tallyloom.operators.intervals import periods_and_gaps
from tallyloom.operators.skew import at_least_share, nucleotide_code, salted_aggregate
from tallyloom.session import read_table, written


def stripped(column: str):
    """A string without white space around it."""
    return F.regexp_replace(F.col(column), r"^\s+|\s+$", "")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = read_table(spark, sf_dir, "bed_entries").where("chromstart >= 0").select(F.lower(stripped("chrom")).alias("chrom"), "chromstart", "chromend")
    return periods_and_gaps(entries, "chrom", "chromstart", "chromend").select(F.col("entity").alias("chrom"), "kind", "from_pos", "to_pos")


def p4_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = read_table(spark, sf_dir, "minimizer_paths").where("tx_id is not null and minimizer is not null")
    rows = paths.select(nucleotide_code("minimizer").alias("minimizer"), "tx_id", "pos")
    return salted_aggregate(rows, "minimizer", member="tx_id", lowest_highest="pos", once=True)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return at_least_share(written(p4_per_key(spark, sf_dir)), "n_rows", 0.02).select("minimizer")


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    def normalised(table: str) -> DataFrame:
        return read_table(spark, sf_dir, table).select(
            "run", F.upper(stripped("id")).alias("id"), "count", "cpm",
            F.lower(stripped("id_level")).alias("id_level"), F.when(F.col("gene_id") != "", F.col("gene_id")).alias("gene_id"),
        )

    return table_differences(
        normalised("counts"), normalised("counts_copy"), ["run", "id"], ["count", "cpm", "id_level", "gene_id"],
        tolerance={"cpm": 1e-6}, missing_in_left="missing_in_counts", missing_in_right="missing_in_copy",
    )


def p6_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences with what either side has: texts of text fields, numbers of number fields."""
    is_text = F.col("difference").isin("id_level", "gene_id")
    text = lambda c: F.when(is_text, F.col(c)).alias(c)
    number = lambda c: F.when(~is_text, F.col(f"{c}_value")).cast("double").alias(f"{c}_number")
    return _differences(spark, sf_dir).select(
        "run", "id", "difference", "n_rows", text("left_value"), text("right_value"), number("left"), number("right")
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differences(spark, sf_dir).select("run", "id", "difference")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p4_found": p4_found, "p4_per_key": p4_per_key, "p6_found": p6_found, "p6_differences": p6_differences}


PER_KEY = """
    WITH usable AS (
        SELECT DISTINCT tx_id, pos, replace(upper(minimizer), 'N', 'G') AS minimizer FROM minimizer_paths
        WHERE tx_id IS NOT NULL AND minimizer IS NOT NULL
    )
    SELECT minimizer, count(*) AS n_rows, count(DISTINCT tx_id) AS n_members, min(pos) AS lowest, max(pos) AS highest
    FROM usable GROUP BY minimizer
"""


#: Every version of a key on either side; a field differs if a side has a value of it that no version of the other has.
DIFFERENCES = r"""
    WITH a AS (
        SELECT DISTINCT run, upper(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS id, "count", cpm,
            lower(regexp_replace(id_level, '^\s+|\s+$', '', 'g')) AS id_level, nullif(gene_id, '') AS gene_id FROM counts
    ), b AS (
        SELECT DISTINCT run, upper(regexp_replace(id, '^\s+|\s+$', '', 'g')) AS id, "count", cpm,
            lower(regexp_replace(id_level, '^\s+|\s+$', '', 'g')) AS id_level, nullif(gene_id, '') AS gene_id FROM counts_copy
    ), keys_of_a AS (SELECT run, id, count(*) AS n FROM a GROUP BY run, id
    ), keys_of_b AS (SELECT run, id, count(*) AS n FROM b GROUP BY run, id
    ), long_a AS (
        SELECT run, id, 'count' AS f, NULL AS t, CAST("count" AS DOUBLE) AS x FROM a UNION SELECT run, id, 'cpm', NULL, cpm FROM a
        UNION SELECT run, id, 'id_level', id_level, NULL FROM a UNION SELECT run, id, 'gene_id', gene_id, NULL FROM a
    ), long_b AS (
        SELECT run, id, 'count' AS f, NULL AS t, CAST("count" AS DOUBLE) AS x FROM b UNION SELECT run, id, 'cpm', NULL, cpm FROM b
        UNION SELECT run, id, 'id_level', id_level, NULL FROM b UNION SELECT run, id, 'gene_id', gene_id, NULL FROM b
    ), both_sides AS (
        SELECT l.run, l.id, l.f, l.t AS t1, r.t AS t2, l.x AS x1, r.x AS x2,
            coalesce(l.t IS NOT DISTINCT FROM r.t AND (l.x IS NOT DISTINCT FROM r.x
                OR (l.f = 'cpm' AND abs(l.x - r.x) <= 1e-6 * greatest(abs(l.x), abs(r.x)))), false) AS same
        FROM long_a AS l JOIN long_b AS r ON l.run IS NOT DISTINCT FROM r.run AND l.id IS NOT DISTINCT FROM r.id AND l.f = r.f
    ), of_a AS (SELECT run, id, f, t1, x1, bool_or(same) AS met FROM both_sides GROUP BY ALL
    ), of_b AS (SELECT run, id, f, t2, x2, bool_or(same) AS met FROM both_sides GROUP BY ALL
    ), shown_a AS (
        SELECT run, id, f, bool_or(NOT met) AS lone, CASE WHEN bool_or(NOT met) THEN min(t1) FILTER (NOT met) ELSE min(t1) END AS t,
            CASE WHEN bool_or(NOT met) THEN min(x1) FILTER (NOT met) ELSE min(x1) END AS x FROM of_a GROUP BY run, id, f
    ), shown_b AS (
        SELECT run, id, f, bool_or(NOT met) AS lone, CASE WHEN bool_or(NOT met) THEN min(t2) FILTER (NOT met) ELSE min(t2) END AS t,
            CASE WHEN bool_or(NOT met) THEN min(x2) FILTER (NOT met) ELSE min(x2) END AS x FROM of_b GROUP BY run, id, f
    )
    SELECT run, id, 'missing_in_copy' AS difference, n AS n_rows, NULL AS left_value, NULL AS right_value,
        CAST(NULL AS DOUBLE) AS left_number, CAST(NULL AS DOUBLE) AS right_number FROM keys_of_a
    WHERE NOT EXISTS (SELECT 1 FROM b WHERE keys_of_a.run IS NOT DISTINCT FROM b.run AND keys_of_a.id IS NOT DISTINCT FROM b.id)
    UNION ALL SELECT run, id, 'missing_in_counts', n, NULL, NULL, NULL, NULL FROM keys_of_b
    WHERE NOT EXISTS (SELECT 1 FROM a WHERE keys_of_b.run IS NOT DISTINCT FROM a.run AND keys_of_b.id IS NOT DISTINCT FROM a.id)
    UNION ALL SELECT l.run, l.id, l.f, 1, l.t, r.t, l.x, r.x FROM shown_a AS l
    JOIN shown_b AS r ON l.run IS NOT DISTINCT FROM r.run AND l.id IS NOT DISTINCT FROM r.id AND l.f = r.f WHERE l.lone OR r.lone
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
            WITH iv AS (
                SELECT DISTINCT lower(regexp_replace(chrom, '^\s+|\s+$', '', 'g')) AS chrom, CAST(chromstart AS BIGINT) AS s, CAST(chromend AS BIGINT) AS e
                FROM bed_entries WHERE chrom IS NOT NULL AND chromstart >= 0 AND chromend > chromstart
            ), flagged AS (
                SELECT chrom, s, e, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv
            ), numbered AS (
                SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
                FROM flagged
            ), periods AS (
                SELECT chrom, island, min(s) AS f, max(e) AS t FROM numbered GROUP BY chrom, island
            )
            SELECT chrom, 'period' AS kind, f AS from_pos, t AS to_pos FROM periods
            UNION ALL
            SELECT chrom, 'gap', previous, f FROM (SELECT chrom, f, lag(t) OVER (PARTITION BY chrom ORDER BY island) AS previous FROM periods)
            WHERE previous IS NOT NULL
        """,
        "p4_per_key": PER_KEY,
        "p4_found": f"WITH k AS ({PER_KEY}) SELECT minimizer FROM k WHERE n_rows >= 0.02 * (SELECT sum(n_rows) FROM k)",
        "p6_differences": DIFFERENCES,
        "p6_found": f"SELECT run, id, difference FROM ({DIFFERENCES})",
    }
