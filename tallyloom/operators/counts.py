"""Counts of genes, transcripts and barcodes, and the sparse matrix made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import written


def counts_by_level(assignments: DataFrame) -> DataFrame:
    """``level, id, gene_id, n``: reads of each transcript and of each gene; a read of a transcript counts for its gene too."""
    tx = assignments.where("tx_id is not null").groupBy(F.col("tx_id").cast("string").alias("id"), F.col("gene_id").cast("string").alias("gene_id")).count()
    genes = assignments.where("gene_id is not null").groupBy(F.col("gene_id").cast("string").alias("id")).count()
    return (
        genes.select(F.lit("gene").alias("level"), "id", F.col("id").alias("gene_id"), F.col("count").alias("n"))
        .unionByName(tx.select(F.lit("transcript").alias("level"), "id", "gene_id", F.col("count").alias("n")))
    )


def molecule_counts(reads: DataFrame, *, barcode: str, feature: list[str], umi: str, batch: str | None = None) -> DataFrame:
    """``<barcode>, <feature>, n``: distinct UMIs of each barcode and feature.

    By default over all reads. With ``batch`` (a column) a UMI counts once in each batch. Nulls count as no UMI.
    """
    scope = [barcode, *feature] + [batch] * bool(batch)
    molecules = reads.where(f"`{umi}` is not null").select(*scope, umi).distinct()
    return molecules.groupBy(barcode, *feature).agg(F.count(F.lit(1)).alias("n"))


def dense_ids(df: DataFrame, column: str, *, first: int = 0) -> DataFrame:
    """``<column>, id``: the distinct non-null values numbered in ascending order from ``first``.

    Values are range-partitioned and sorted; a partition's ids start after the sizes of those before it. Only these
    sizes, one number for each partition, pass through the driver; no task holds all values.
    """
    values = df.select(column).where(f"`{column}` is not null").distinct()
    numbered = written(
        values.repartitionByRange(column).sortWithinPartitions(column).withColumn("__row", F.monotonically_increasing_id())
    ).withColumn("__part", F.shiftrightunsigned("__row", 33))
    sizes = sorted((r["__part"], r["n"]) for r in numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, so_far = [], first
    for part, n in sizes:
        starts.append((part, so_far))
        so_far += n
    offsets = df.sparkSession.createDataFrame(starts, "__part bigint, __start bigint")
    id_ = F.col("__start") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.join(F.broadcast(offsets), "__part").select(column, id_.alias("id"))


def matrix_entries(counts: DataFrame, features: DataFrame, barcodes: DataFrame, *, feature: str, barcode: str) -> DataFrame:
    """``feature_idx, barcode_idx, n`` of a counts table and its two dictionaries (``dense_ids`` from 1)."""
    return (
        counts.join(features.withColumnRenamed("id", "feature_idx"), feature).join(barcodes.withColumnRenamed("id", "barcode_idx"), barcode)
        .select("feature_idx", "barcode_idx", "n")
    )


def filtered_cells(counts: DataFrame, *, cell: str, gene: str, least_genes: int, least_cells: int) -> DataFrame:
    """``counts`` without cells of fewer than ``least_genes`` genes, then without genes in fewer than ``least_cells`` cells."""
    positive = counts.where("n > 0")
    cells = positive.groupBy(cell).agg(F.count(F.lit(1)).alias("n_genes")).where(F.col("n_genes") >= least_genes).select(cell)
    kept = positive.join(cells, cell, "left_semi")
    genes = kept.groupBy(gene).agg(F.count(F.lit(1)).alias("n_cells")).where(F.col("n_cells") >= least_cells).select(gene)
    return kept.join(genes, gene, "left_semi")


def normalised(counts: DataFrame, *, cell: str, target: float = 1e4) -> DataFrame:
    """Adds ``value``: log1p of the count scaled so that each cell sums to ``target``. The sums are aggregated and joined, so a large cell is not one task."""
    totals = counts.groupBy(cell).agg(F.sum("n").alias("__total"))
    return counts.join(totals, cell).withColumn("value", F.log1p(F.col("n") / F.col("__total") * target)).drop("__total")


def variable_genes(values: DataFrame, *, gene: str, n_cells: int, top: int = 2000) -> DataFrame:
    """The ``top`` genes by variance over all cells (absent entries are 0), with mean and deviation for scaling."""
    sums = values.groupBy(gene).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    mean = F.col("s") / n_cells
    variance = (F.col("q") - F.col("s") * mean) / max(n_cells - 1, 1)
    return sums.select(gene, mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sd")).orderBy(F.desc("sd"), gene).limit(top)


def scaled(values: DataFrame, genes: DataFrame, *, gene: str, most: float = 10.0) -> DataFrame:
    """Adds ``z``: values of the given genes in deviations from their mean, at most ``most``."""
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return values.join(genes, gene).withColumn("z", F.least(z, F.lit(most))).drop("mean", "sd")


def cell_vectors(values: DataFrame, genes: DataFrame, *, cell: str, gene: str, most: float = 10.0) -> DataFrame:
    """``<cell>, vector``: each cell's scaled values of the given genes (``variable_genes``) in the order of their names.

    A gene that a cell lacks has the value 0 before scaling. Genes are no more than the ``top`` they were chosen with: they are
    collected, and a cell's list of values has at most that length.
    """
    chosen = sorted(genes.collect(), key=lambda r: r[gene])
    absent = [min(-r["mean"] / r["sd"], most) if r["sd"] > 0 else 0.0 for r in chosen]
    places = values.sparkSession.createDataFrame([(r[gene], i) for i, r in enumerate(chosen)], f"`{gene}` {dict(genes.dtypes)[gene]}, __place int")
    placed = scaled(values, genes, gene=gene, most=most).join(F.broadcast(places), gene)
    given = placed.groupBy(cell).agg(F.map_from_entries(F.collect_list(F.struct("__place", "z"))).alias("given"))
    every = values.select(cell).distinct().join(given, cell, "left")
    base = F.array(*map(F.lit, absent)) if absent else F.array().cast("array<double>")
    vector = F.transform(base, lambda z, i: F.coalesce(F.try_element_at("given", i), z))
    return every.select(cell, vector.alias("vector"))


def top_by_group(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Rows with the highest value of their group, ties kept. The maxima are aggregated and joined back, so no group is sorted in one task."""
    highest = df.groupBy(*[F.col(g).alias(f"__group_{i}") for i, g in enumerate(group)]).agg(F.max(value).alias("__highest"))
    same = F.col(value) == F.col("__highest")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__group_{i}"))
    return df.join(highest, same).select(*df.columns)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, *, weight: str | None = None) -> DataFrame:
    """``bin, n``: rows (or the sum of ``weight``) in each of ``bins`` equal bins; 0 is below ``low``, ``bins + 1`` from ``high`` on."""
    of = F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins))
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.where(f"`{value}` is not null").groupBy(of.alias("bin")).agg(n.alias("n"))


def rolling_sum(df: DataFrame, key: str, order: list[str], value: str, k: int) -> DataFrame:
    """Adds ``rolling``: the sum of ``value`` over a row and the ``k - 1`` before it of its key; null in the first ``k - 1`` rows."""
    along = Window.partitionBy(key).orderBy(*order)
    sums = F.sum(value).over(along.rowsBetween(1 - k, 0))
    return df.withColumn("rolling", F.when(F.row_number().over(along) >= k, sums))
