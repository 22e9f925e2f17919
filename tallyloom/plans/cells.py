"""Queries on barcoded reads: molecule counts, sparse matrices, cell filters, quality frames, vectors and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.sequence import gc_share
from tallyloom.operators import counts
from tallyloom.operators.evaluate import status_shares
from tallyloom.operators.graph import mapping_differences
from tallyloom.operators.nearest import nearest, principal_components
from tallyloom.operators.simulate import first_reads
from tallyloom.session import read_table, shared_folder, written
from tallyloom.streaming.running import read_stream, run_batches, running_counts


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with known barcode and UMI in upper case; slide and lane together are the feature."""
    rows = read_table(spark, sf_dir, "barcode_umi").where("barcode is not null and umi is not null and barcode <> 'UNKNOWN' and umi <> 'UNKNOWN'")
    return rows.select(
        "read_id", F.upper("barcode").alias("barcode"), F.upper("umi").alias("umi"), F.concat_ws("/", F.coalesce("slide", F.lit("none")), F.coalesce(F.col("lane").cast("string"), F.lit("none"))).alias("feature")
    )


def umi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.molecule_counts(_reads(spark, sf_dir), barcode="barcode", feature=["feature"], umi="umi")


def umi_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UMIs distinct within batches of 10 000 reads only."""
    rows = _reads(spark, sf_dir).withColumn("batch", F.floor(F.col("read_id") / 10_000))
    return counts.molecule_counts(rows, barcode="barcode", feature=["feature"], umi="umi", batch="batch")


def matrix_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.dense_ids(_reads(spark, sf_dir), "feature", first=1)


def matrix_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.dense_ids(_reads(spark, sf_dir), "barcode", first=1)


def matrix_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.matrix_entries(umi_counts(spark, sf_dir), matrix_features(spark, sf_dir), matrix_barcodes(spark, sf_dir), feature="feature", barcode="barcode")


def matrix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return umi_counts(spark, sf_dir).groupBy("feature").agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("barcode").alias("n_barcodes"), F.sum("n").alias("total"))


def cell_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.filtered_cells(umi_counts(spark, sf_dir), cell="barcode", gene="feature", least_genes=2, least_cells=3)


def normalised_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.normalised(umi_counts(spark, sf_dir), cell="barcode").select("barcode", "feature", F.round("value", 6).alias("value"))


def variable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = written(counts.normalised(umi_counts(spark, sf_dir), cell="barcode"))
    n_cells = values.select("barcode").distinct().count()
    top = counts.variable_genes(values, gene="feature", n_cells=n_cells, top=2000)
    return top.select("feature", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised values of the most variable features, in deviations from their mean."""
    values = written(counts.normalised(umi_counts(spark, sf_dir), cell="barcode"))
    n_cells = values.select("barcode").distinct().count()
    top = counts.variable_genes(values, gene="feature", n_cells=n_cells, top=20)
    return counts.scaled(values, top, gene="feature").select("barcode", "feature", F.round("z", 4).alias("z"))


def _cell_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered, normalised and scaled cells over the 2000 most variable features."""
    kept = counts.filtered_cells(umi_counts(spark, sf_dir), cell="barcode", gene="feature", least_genes=2, least_cells=3)
    values = written(counts.normalised(kept, cell="barcode"))
    top = counts.variable_genes(values, gene="feature", n_cells=values.select("barcode").distinct().count(), top=2000)
    return counts.cell_vectors(values, top, cell="barcode", gene="feature")


def cell_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest cells, by up to 40 principal components, of each cell whose number in the matrix is divisible by 50."""
    vectors = written(_cell_vectors(spark, sf_dir))
    length = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    if not length:
        return spark.createDataFrame([], "query string, neighbour string, place int, distance double")
    reduced = written(principal_components(vectors, key="barcode", vector="vector", k=min(40, length)))
    asked = counts.dense_ids(reduced, "barcode").where("id % 50 = 0").select("barcode")
    found = nearest(reduced, reduced.join(asked, "barcode", "left_semi"), key="barcode", vector="components", k=10)
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return found.select("query", "neighbour", place.alias("place"), F.round("distance", 4).alias("distance"))


def read_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "barcode_umi")
    status = F.when(F.col("barcode").isNull() | F.col("umi").isNull(), "missing").when((F.col("barcode") == "UNKNOWN") | (F.col("umi") == "UNKNOWN"), "short").when(
        F.upper("barcode").contains("N") | F.upper("umi").contains("N"), "unclear").otherwise("clear")
    return status_shares(rows.select(status.alias("status")), "status")


def base_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases at each position of a barcode. Equal barcodes are counted before they are taken apart."""
    barcodes = _reads(spark, sf_dir).groupBy("barcode").agg(F.count(F.lit(1)).alias("n"))
    rows = barcodes.select("n", F.posexplode(F.split("barcode", "")).alias("pos", "base"))
    return rows.groupBy("pos").pivot("base", ["A", "C", "G", "T", "N"]).agg(F.sum("n")).fillna(0)


def gc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.histogram(_reads(spark, sf_dir).select(gc_share(F.concat("barcode", "umi")).alias("gc")), "gc", 0, 1, 43)


def duplication_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _reads(spark, sf_dir).groupBy("barcode", "umi").agg(F.count(F.lit(1)).alias("level"))
    return sizes.groupBy("level").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("level").alias("n_reads"))


def common_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 most frequent first halves of UMIs (a top-k report)."""
    starts = _reads(spark, sf_dir).groupBy(F.substring("umi", 1, 8).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return starts.orderBy(F.desc("n"), "start").limit(100)


def unmatched_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcodes that a single lane has and none of the others, and which it is."""
    seen = read_table(spark, sf_dir, "barcode_umi").where("lane is not null and barcode is not null").groupBy(F.upper("barcode").alias("barcode"))
    lone = seen.agg(F.min("lane").alias("lane"), F.max("lane").alias("last")).where("lane = last")
    return lone.select("barcode", F.concat(F.lit("lane_"), F.col("lane").cast("string")).alias("side"))


def lane_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``barcode, lane, missing_on``: of each two lanes of the table, the barcodes that only one of them has."""
    table = read_table(spark, sf_dir, "barcode_umi").where("lane is not null and barcode is not null")
    seen = table.select("lane", F.upper("barcode").alias("barcode")).distinct()
    lanes = table.select("lane").distinct()
    pairs = F.broadcast(lanes.select(F.col("lane").alias("a")).join(lanes.select(F.col("lane").alias("b")), F.col("a") < F.col("b")))  # lanes are few
    of = lambda side: seen.join(pairs, F.col("lane") == F.col(side)).select(F.struct("a", "b").alias("lanes"), "barcode")
    found = mapping_differences(of("a"), of("b"), locus="lanes", read="barcode")
    only_a = F.col("side") == "a"
    return found.select("barcode", F.when(only_a, F.col("lanes.a")).otherwise(F.col("lanes.b")).alias("lane"), F.when(only_a, F.col("lanes.b")).otherwise(F.col("lanes.a")).alias("missing_on"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    found = nearest(vectors, vectors.where("vec_id % 50 = 0"), key="vec_id", vector="embedding", k=10)
    return found.select("query", "neighbour", F.round("distance", 5).alias("distance"))


def vector_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = principal_components(read_table(spark, sf_dir, "embeddings"), key="vec_id", vector="embedding", k=10)
    return found.select("vec_id", F.posexplode("components").alias("component", "value")).withColumn("value", F.round("value", 4))


def first_read_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules of the first 10 000 reads (a subset operation: reads sent twice count once)."""
    reads = read_table(spark, sf_dir, "barcode_umi").where("read_id is not null").groupBy("read_id").agg(F.max(F.upper("barcode")).alias("barcode"), F.max(F.upper("umi")).alias("umi"))
    return first_reads(reads, 10_000).where("barcode is not null").groupBy("barcode").agg(F.count_distinct("umi").alias("n"))


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of each slide and lane, counted over a stream of the table's files."""
    table = read_table(spark, sf_dir, "barcode_umi")
    name = f"stream-{uuid.uuid4().hex}"
    out = f"{shared_folder(spark)}/{name}/counts"
    schema = ", ".join(f"`{c}` {t}" for c, t in table.dtypes)
    stream = running_counts(read_stream(spark, f"{sf_dir}/barcode_umi.parquet", schema), ["slide", "lane"])
    run_batches(stream, lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}"), name)
    updates = spark.read.option("recursiveFileLookup", True).schema("slide string, lane int, n bigint, batch bigint").parquet(out)
    return updates.groupBy("slide", "lane").agg(F.max_by("n", "batch").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        umi_counts, umi_batch_counts, matrix_features, matrix_barcodes, matrix_entries, matrix_sizes, cell_filters, normalised_cells, variable_features, scaled_features, read_status,
        base_content, gc_histogram, duplication_levels, common_starts, unmatched_reads, lane_differences, nearest_vectors, vector_components, cell_neighbours, first_read_counts, streamed_counts,
    )
    return {f.__name__: f for f in own}


READS = """
    SELECT read_id, upper(barcode) AS barcode, upper(umi) AS umi, coalesce(slide, 'none') || '/' || coalesce(CAST(lane AS VARCHAR), 'none') AS feature FROM barcode_umi
    WHERE barcode IS NOT NULL AND umi IS NOT NULL AND barcode <> 'UNKNOWN' AND umi <> 'UNKNOWN'
"""
UMIS = f"SELECT barcode, feature, count(DISTINCT umi) AS n FROM ({READS}) GROUP BY 1, 2"
VALUES = f"SELECT barcode, feature, ln(1 + n / sum(n) OVER (PARTITION BY barcode) * 10000) AS value FROM ({UMIS})"
FEATURES = f"SELECT feature, row_number() OVER (ORDER BY feature) AS id FROM (SELECT DISTINCT feature FROM ({READS}))"
COLUMNS = f"SELECT barcode, row_number() OVER (ORDER BY barcode) AS id FROM (SELECT DISTINCT barcode FROM ({READS}))"


def oracle_sql() -> dict[str, str]:
    bases = ", ".join(f"CAST(sum(CASE WHEN base = '{b}' THEN 1 ELSE 0 END) AS BIGINT) AS {b}" for b in "ACGTN")
    return {
        "umi_counts": UMIS,
        "umi_batch_counts": f"SELECT barcode, feature, count(DISTINCT (umi, read_id // 10000)) AS n FROM ({READS}) GROUP BY 1, 2",
        "matrix_features": FEATURES,
        "matrix_barcodes": COLUMNS,
        "matrix_entries": f"SELECT f.id AS feature_idx, b.id AS barcode_idx, n FROM ({UMIS}) AS u JOIN ({FEATURES}) AS f USING (feature) JOIN ({COLUMNS}) AS b USING (barcode)",
        "matrix_sizes": f"SELECT feature, count(*) AS n_entries, count(DISTINCT barcode) AS n_barcodes, CAST(sum(n) AS BIGINT) AS total FROM ({UMIS}) GROUP BY 1",
        "cell_filters": f"""
            WITH kept AS (SELECT * FROM ({UMIS}) WHERE n > 0 AND barcode IN (SELECT barcode FROM ({UMIS}) WHERE n > 0 GROUP BY 1 HAVING count(*) >= 2))
            SELECT barcode, feature, n FROM kept WHERE feature IN (SELECT feature FROM kept GROUP BY 1 HAVING count(*) >= 3)
        """,
        "normalised_cells": f"SELECT barcode, feature, round(value, 6) AS value FROM ({VALUES})",
        "variable_features": f"""
            WITH v AS ({VALUES}), c AS (SELECT count(DISTINCT barcode) AS cells FROM v)
            SELECT feature, round(sum(value) / any_value(cells), 4) AS mean,
                round(sqrt(greatest((sum(value * value) - sum(value) * sum(value) / any_value(cells)) / (any_value(cells) - 1), 0)), 4) AS sd
            FROM v, c GROUP BY feature
        """,
        "scaled_features": f"""
            WITH v AS ({VALUES}), c AS (SELECT count(DISTINCT barcode) AS cells FROM v), g AS (
                SELECT feature, sum(value) / any_value(cells) AS mean,
                    sqrt(greatest((sum(value * value) - sum(value) * sum(value) / any_value(cells)) / (any_value(cells) - 1), 0)) AS sd
                FROM v, c GROUP BY feature ORDER BY sd DESC, feature LIMIT 20
            )
            SELECT barcode, feature, round(CASE WHEN sd > 0 THEN least((value - mean) / sd, 10) ELSE 0 END, 4) AS z FROM v JOIN g USING (feature)
        """,
        "cell_neighbours": f"""
            WITH many AS (SELECT * FROM ({UMIS}) WHERE n > 0 AND barcode IN (SELECT barcode FROM ({UMIS}) WHERE n > 0 GROUP BY 1 HAVING count(*) >= 2)),
            kept AS (SELECT * FROM many WHERE feature IN (SELECT feature FROM many GROUP BY 1 HAVING count(*) >= 3)),
            v AS (SELECT barcode, feature, ln(1 + n / sum(n) OVER (PARTITION BY barcode) * 10000) AS value FROM kept),
            cells AS (SELECT barcode, row_number() OVER (ORDER BY barcode) - 1 AS id FROM (SELECT DISTINCT barcode FROM v)),
            g AS (
                SELECT feature, sum(value) / (SELECT count(*) FROM cells) AS mean,
                    sqrt(greatest((sum(value * value) - sum(value) * sum(value) / (SELECT count(*) FROM cells)) / ((SELECT count(*) FROM cells) - 1), 0)) AS sd
                FROM v GROUP BY feature ORDER BY sd DESC, feature LIMIT 2000
            ),
            x AS (
                SELECT c.barcode, c.id, list(CASE WHEN sd > 0 THEN least((coalesce(value, 0) - mean) / sd, 10) ELSE 0 END ORDER BY g.feature) AS z
                FROM cells AS c CROSS JOIN g LEFT JOIN v ON v.barcode = c.barcode AND v.feature = g.feature GROUP BY 1, 2
            )
            SELECT query, neighbour, CAST(place AS INTEGER) AS place, round(distance, 4) AS distance FROM (
                SELECT q.barcode AS query, o.barcode AS neighbour, list_distance(q.z, o.z) AS distance, row_number() OVER (PARTITION BY q.barcode ORDER BY round(list_distance(q.z, o.z), 9), o.barcode) AS place
                FROM x AS q JOIN x AS o ON q.id % 50 = 0 AND o.barcode <> q.barcode
            ) WHERE place <= 10
        """,
        "read_status": """
            SELECT status, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM barcode_umi), 4) AS percent FROM (
                SELECT CASE WHEN barcode IS NULL OR umi IS NULL THEN 'missing' WHEN barcode = 'UNKNOWN' OR umi = 'UNKNOWN' THEN 'short'
                    WHEN contains(upper(barcode), 'N') OR contains(upper(umi), 'N') THEN 'unclear' ELSE 'clear' END AS status FROM barcode_umi
            ) GROUP BY status
        """,
        "base_content": f"SELECT CAST(i - 1 AS INTEGER) AS pos, {bases} FROM (SELECT i, substr(barcode, i, 1) AS base FROM ({READS}), unnest(range(1, 28)) AS u(i) WHERE i <= length(barcode)) GROUP BY i",
        "gc_histogram": f"""
            SELECT CAST(CASE WHEN gc >= 1 THEN 44 ELSE floor(gc / (1.0 / 43)) + 1 END AS BIGINT) AS bin, count(*) AS n
            FROM (SELECT CAST(length(regexp_replace(barcode || umi, '[^GC]', '', 'g')) AS DOUBLE) / length(barcode || umi) AS gc FROM ({READS})) GROUP BY 1
        """,
        "duplication_levels": f"SELECT level, count(*) AS n_sequences, CAST(sum(level) AS BIGINT) AS n_reads FROM (SELECT count(*) AS level FROM ({READS}) GROUP BY barcode, umi) GROUP BY level",
        "common_starts": f"SELECT substr(umi, 1, 8) AS start, count(*) AS n FROM ({READS}) GROUP BY 1 ORDER BY n DESC, start LIMIT 100",
        "unmatched_reads": """
            WITH seen AS (SELECT DISTINCT lane, upper(barcode) AS barcode FROM barcode_umi WHERE lane IS NOT NULL AND barcode IS NOT NULL)
            SELECT barcode, 'lane_' || lane AS side FROM seen AS s WHERE NOT EXISTS (SELECT 1 FROM seen AS o WHERE o.barcode = s.barcode AND o.lane <> s.lane)
        """,
        "lane_differences": """
            WITH seen AS (SELECT DISTINCT lane, upper(barcode) AS barcode FROM barcode_umi WHERE lane IS NOT NULL AND barcode IS NOT NULL), lanes AS (SELECT DISTINCT lane FROM seen)
            SELECT s.barcode, s.lane, l.lane AS missing_on FROM seen AS s CROSS JOIN lanes AS l WHERE NOT EXISTS (SELECT 1 FROM seen AS o WHERE o.barcode = s.barcode AND o.lane = l.lane)
        """,
        "nearest_vectors": """
            SELECT query, neighbour, round(distance, 5) AS distance FROM (
                SELECT q.vec_id AS query, v.vec_id AS neighbour, sqrt(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (CAST(q.embedding[i] AS DOUBLE) - CAST(v.embedding[i] AS DOUBLE)) ** 2))) AS distance,
                    row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, v.vec_id) AS place
                FROM embeddings AS q JOIN embeddings AS v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id
            ) WHERE place <= 10
        """,
        "first_read_counts": """
            SELECT barcode, count(DISTINCT umi) AS n FROM (
                SELECT read_id, max(upper(barcode)) AS barcode, max(upper(umi)) AS umi FROM barcode_umi WHERE read_id IS NOT NULL GROUP BY read_id ORDER BY read_id LIMIT 10000
            ) WHERE barcode IS NOT NULL GROUP BY barcode
        """,
        "streamed_counts": "SELECT slide, lane, count(*) AS n FROM barcode_umi GROUP BY 1, 2",
    }
