"""Writers of indexes, counts, matrices and assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.counts import dense_ids, matrix_entries
from tallyloom.operators.index import check_lengths
from tallyloom.sources.readers import SUMMARY


def write_index(paths: DataFrame, postings: DataFrame, folder: str, *, k: int, m: int) -> None:
    """An index as Parquet tables: ``index_meta`` (one row), ``paths``, and ``postings`` sorted by triplet within its files."""
    check_lengths(k, m)
    spark = paths.sparkSession
    spark.createDataFrame([(1, k, m)], "version int, k int, m int").write.mode("overwrite").parquet(f"{folder}/index_meta")
    paths.write.mode("overwrite").parquet(f"{folder}/paths")
    postings.repartition("a", "b", "c").sortWithinPartitions("a", "b", "c").write.mode("overwrite").parquet(f"{folder}/postings")


def read_index(spark: SparkSession, folder: str) -> tuple[int, int, DataFrame, DataFrame]:
    """(k, m, paths, postings) of an index; raises if it is of another version."""
    version, k, m = spark.read.parquet(f"{folder}/index_meta").first()
    if version != 1:
        raise ValueError(f"index of version {version}")
    return k, m, spark.read.parquet(f"{folder}/paths"), spark.read.parquet(f"{folder}/postings")


def write_counts(counts: DataFrame, path: str) -> None:
    """``id⇥n`` lines, each gene before its transcripts; several files whose order is that of their names."""
    ordered = counts.orderBy("gene_id", F.when(F.col("level") == "gene", 0).otherwise(1), "id")
    ordered.select("id", "n").write.mode("overwrite").csv(path, sep="\t")


def write_table(df: DataFrame, path: str, *, sep: str = "\t", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def write_bed(rows: DataFrame, path: str) -> None:
    """BED lines sorted by name and start."""
    rows.select("chrom", "chromstart", "chromend", "name", "score", "strand").orderBy("name", "chromstart").write.mode("overwrite").csv(path, sep="\t")


def write_assignments(assignments: DataFrame, path: str, *, read: str = "read_id") -> None:
    """One id for each read in the order of the reads: ``*`` for short, ``-`` for ambiguous, else transcript or gene."""
    named = F.coalesce(F.col("tx_id").cast("string"), F.col("gene_id").cast("string"))
    line = F.when(F.col("status") == "short", "*").when(F.col("status") == "ambiguous", "-").otherwise(named)
    assignments.orderBy(read).select(line.alias("value")).write.mode("overwrite").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """The counters of ``run_summary`` as ``label: number`` lines, as ``read_summaries`` reads them."""
    lines = F.array(*[F.format_string("%s: %d", F.lit(label), F.col(c)) for c, label in SUMMARY.items()])
    summary.select(F.array_join(lines, "\n").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_matrix(counts: DataFrame, barcodes: DataFrame, folder: str, *, feature: str, level: str, barcode: str) -> None:
    """``matrix``, ``barcodes`` and ``features`` as text, 1-based; genes before transcripts; all barcodes are columns, also without counts.

    Each is a folder of files whose order is that of their names; the first line of ``matrix`` has its dimensions.
    """
    named = counts.withColumn("__name", F.concat(F.when(F.col(level) == "gene", "0").otherwise("1"), F.col(feature)))
    features, columns = dense_ids(named, "__name", first=1), dense_ids(barcodes, barcode, first=1)
    entries = matrix_entries(named, features, columns, feature="__name", barcode=barcode)
    n_features, n_barcodes, n_entries = features.count(), columns.count(), entries.count()
    kind = F.when(F.substring("__name", 1, 1) == "0", "gene").otherwise("transcript")
    features.orderBy("id").select(F.concat_ws("\t", F.expr("substring(__name, 2)"), F.expr("substring(__name, 2)"), kind)).write.mode("overwrite").text(f"{folder}/features.tsv")
    columns.orderBy("id").select(F.col(barcode)).write.mode("overwrite").text(f"{folder}/barcodes.tsv")
    head = counts.sparkSession.createDataFrame(
        [(0, 0, "%%MatrixMarket matrix coordinate integer general"), (0, 1, f"{n_features} {n_barcodes} {n_entries}")], "f bigint, b bigint, value string"
    )
    lines = entries.select(F.col("feature_idx").alias("f"), F.col("barcode_idx").alias("b"), F.concat_ws(" ", "feature_idx", "barcode_idx", "n").alias("value"))
    head.union(lines).orderBy("f", "b").select("value").write.mode("overwrite").text(f"{folder}/matrix.mtx")
