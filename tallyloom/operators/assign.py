"""Two-phase assignment of reads to transcripts and genes, as set algebra over triplet hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def triplet_hits(read_triplets: DataFrame, index: DataFrame, read: str) -> DataFrame:
    """``<read>, pos, tx_id, gene_id``: transcripts of each triplet of a read. Spark broadcasts the index where it is measured to be small."""
    return read_triplets.join(index, ["a", "b", "c"]).select(read, "pos", "tx_id", "gene_id")


def assign_reads(reads: DataFrame, read_triplets: DataFrame, index: DataFrame, *, read: str = "read_id") -> DataFrame:
    """``<read>, status, tx_id, gene_id`` for every read.

    Phase one intersects the transcript sets of successive triplets until the intersection belongs to one gene; if
    it then is one transcript, that is assigned (``h_tx``). Otherwise phase two scores the union of the sets by
    successive hits and takes the best: one transcript (``h_tx`` or ``s_tx``), several of one gene (``h_gene`` or
    ``s_gene``), else ``ambiguous``; h where phase one had found the gene. Reads without a triplet are ``short``. A null
    gene is a group of its own per transcript.

    With l(tx) the length of the unbroken run of hits from the first triplet on, the intersection of the first i sets is
    {tx: l(tx) >= i}; it changes at i = 1 and i = l + 1 only. So phase one needs no loop.
    """
    gene = F.coalesce("gene_id", F.concat(F.lit("\x00"), F.col("tx_id").cast("string")))
    hits = triplet_hits(read_triplets, index, read).withColumn("gene", gene)
    along = Window.partitionBy(read, "tx_id").orderBy("pos")
    per_tx = (
        hits.select(
            read, "tx_id", "gene", "gene_id",
            (F.col("pos") == F.row_number().over(along)).cast("int").alias("unbroken"),
            (F.lead("pos").over(along) == F.col("pos") + 1).cast("int").alias("follows"),
        )
        .groupBy(read, "tx_id").agg(
            F.sum("unbroken").alias("run"), F.coalesce(F.sum("follows"), F.lit(0)).alias("score"),
            F.first("gene").alias("gene"), F.first("gene_id").alias("gene_id"),
        )
    )
    # phase one: from the longest run down, the transcripts still in; the first step with one gene is the largest such set
    by_run = Window.partitionBy(read).orderBy(F.desc("run")).rangeBetween(Window.unboundedPreceding, 0)
    steps = (
        per_tx.where("run > 0")
        .select(read, "run", "tx_id", "gene_id", F.min("gene").over(by_run).alias("g1"), F.max("gene").over(by_run).alias("g2"), F.count(F.lit(1)).over(by_run).alias("n"))
        .where("g1 = g2").groupBy(read).agg(F.max("n").alias("n_one_gene"), F.max_by(F.struct("tx_id", "gene_id"), "run").alias("one"))
    )
    best = (
        per_tx.withColumn("place", F.rank().over(Window.partitionBy(read).orderBy(F.desc("score")))).where("place = 1")
        .groupBy(read).agg(
            F.count(F.lit(1)).alias("n_best"), F.min("tx_id").alias("best_tx"), F.min("gene").alias("b1"), F.max("gene").alias("b2"),
            F.min("gene_id").alias("best_gene"),
        )
    )
    triplets = read_triplets.select(read).distinct().withColumn("has", F.lit(True))
    joined = reads.select(read).join(triplets, read, "left").join(steps, read, "left").join(best, read, "left")
    status = (
        F.when(F.col("has").isNull(), "short").when(F.col("n_one_gene") == 1, "h_tx").when(F.col("n_best").isNull(), "ambiguous")
        .when(F.col("n_best") == 1, F.when(F.col("n_one_gene") > 1, "h_tx").otherwise("s_tx"))
        .when(F.col("b1") == F.col("b2"), F.when(F.col("n_one_gene") > 1, "h_gene").otherwise("s_gene")).otherwise("ambiguous")
    )
    by_first = F.col("n_one_gene") == 1
    decided = joined.withColumn("status", status)
    return decided.select(
        read, "status",
        F.when(F.col("status").endswith("tx"), F.when(by_first, F.col("one.tx_id")).otherwise(F.col("best_tx"))).alias("tx_id"),
        F.when(F.col("status").rlike("tx|gene"), F.when(by_first, F.col("one.gene_id")).otherwise(F.col("best_gene"))).alias("gene_id"),
    )


def run_summary(assignments: DataFrame) -> DataFrame:
    """One row with the counters of a run: reads, those assigned to transcripts and genes in either phase, ambiguous and short ones."""
    of = lambda *names: F.count_if(F.col("status").isin(*names))
    return assignments.agg(
        F.count(F.lit(1)).alias("reads"), of("h_tx", "s_tx").alias("assigned_tx"), of("h_gene", "s_gene").alias("assigned_gene"),
        of("ambiguous").alias("ambiguous"), of("short").alias("short"), of("h_tx").alias("heuristic_tx"), of("h_gene").alias("heuristic_gene"),
        of("s_tx").alias("scored_tx"), of("s_gene").alias("scored_gene"),
    )
