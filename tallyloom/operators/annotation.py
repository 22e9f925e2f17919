"""Transcripts and their exons: lengths, running widths, last bases, and how well tails tell transcripts apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exon_rows(transcripts: DataFrame) -> DataFrame:
    """One row for each exon, with its number and the bases before it in the direction of transcription.

    Columns: ``transcript_id, gene_id, chrom, is_negative, utr_len, tx_width, exon_start, exon_end, width, number,
    width_before``. Exons are in the given array, 1-based and closed; null arrays give no rows.
    """
    flat = transcripts.select("transcript_id", "gene_id", "chrom", "is_negative", F.coalesce("utr_len", F.lit(0)).alias("utr_len"), F.explode("exons").alias("e"))
    rows = flat.select("*", "e.exon_start", "e.exon_end", (F.col("e.exon_end") - F.col("e.exon_start") + 1).alias("width")).drop("e")
    along = F.when(F.col("is_negative"), -F.col("exon_start")).otherwise(F.col("exon_start"))
    order = Window.partitionBy("transcript_id").orderBy(along, "exon_end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "*", F.sum("width").over(Window.partitionBy("transcript_id")).alias("tx_width"), F.row_number().over(order).alias("number"),
        F.coalesce(F.sum("width").over(before), F.lit(0)).alias("width_before"),
    )


def last_bases(transcripts: DataFrame, k: int, *, with_utr: bool = True) -> DataFrame:
    """The exons of the last ``k`` bases (and the 3' UTR) of each transcript, the first of them trimmed at its 5' end.

    Returns the columns of ``exon_rows`` with trimmed ``exon_start``, ``exon_end`` and ``width``.
    """
    return trimmed(exon_rows(transcripts), F.lit(k), with_utr=with_utr)


def trimmed(exons: DataFrame, k: Column, *, with_utr: bool = True) -> DataFrame:
    """As ``last_bases``, of rows of ``exon_rows`` and a number of bases that may differ from row to row."""
    excess = F.col("tx_width") - (k + (F.col("utr_len") if with_utr else F.lit(0)))
    cut = F.greatest(excess - F.col("width_before"), F.lit(0))
    kept = exons.where(k > 0).withColumn("cut", cut).where(F.col("cut") < F.col("width"))
    return kept.select(
        *[c for c in kept.columns if c not in ("exon_start", "exon_end", "width", "cut")],
        F.when(F.col("is_negative"), F.col("exon_start")).otherwise(F.col("exon_start") + F.col("cut")).alias("exon_start"),
        F.when(F.col("is_negative"), F.col("exon_end") - F.col("cut")).otherwise(F.col("exon_end")).alias("exon_end"),
        (F.col("width") - F.col("cut")).alias("width"),
    )


def at_cutoffs(transcripts: DataFrame, cutoffs: list[int], *, with_utr: bool = True) -> DataFrame:
    """``last_bases`` for several numbers of bases at once, told apart by the column ``cutoff``."""
    exons = exon_rows(transcripts).withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
    return trimmed(exons, F.col("cutoff"), with_utr=with_utr)


def at_cutoff_runs(transcripts: DataFrame, cutoffs: list[int], *, with_utr: bool = True) -> DataFrame:
    """As ``at_cutoffs``, with one row for successive cutoffs at which an exon stays the same: ``first, last`` are their places in ``cutoffs``.

    ``cutoffs`` are above 0 and ascending. Beyond the last cutoff that trims it, an exon is whole at all of them.
    """
    before = [-(2**63), *cutoffs]
    runs = F.array(*[F.struct(F.lit(i).alias("first"), F.lit(k).cast("bigint").alias("k"), F.lit(b).cast("bigint").alias("before")) for i, (k, b) in enumerate(zip(cutoffs, before, strict=False))])
    needed = F.col("tx_width") - (F.col("utr_len") if with_utr else F.lit(0)) - F.col("width_before")  # bases from which on the exon is whole
    exons = exon_rows(transcripts).withColumn("needed", needed).select("*", F.explode(runs).alias("run"))
    kept = exons.where("run.before < needed and run.k > needed - width").select("*", "run.first", F.when(F.col("run.k") < F.col("needed"), F.col("run.first")).otherwise(len(cutoffs) - 1).alias("last"))
    return trimmed(kept, F.col("run.k"), with_utr=with_utr).drop("needed", "run")


def bed_rows(exons: DataFrame) -> DataFrame:
    """Exons as 0-based half-open BED rows."""
    return exons.select(
        "chrom", (F.col("exon_start") - 1).alias("chromstart"), F.col("exon_end").alias("chromend"), F.col("transcript_id").alias("name"),
        F.lit(0).alias("score"), F.when(F.col("is_negative"), "-").otherwise("+").alias("strand"),
    )


def lengths_by_type(features: DataFrame) -> DataFrame:
    """``transcript_id, gene_id, tx_len, utr_len`` from annotation rows with ``feature, start, end``."""
    width = F.col("end") - F.col("start") + 1
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("feature") == kind, width)), F.lit(0))
    return features.groupBy("transcript_id").agg(F.max("gene_id").alias("gene_id"), of("exon").alias("tx_len"), of("three_prime_utr").alias("utr_len"))


def signature(exons: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``transcript_id, <by>, gene_id, signature``: the exon coordinates of each transcript as one string, in ascending order.

    A transcript's exons are few; they are gathered per transcript.
    """
    part: Column = F.struct("exon_start", "exon_end")
    return exons.groupBy("transcript_id", *by).agg(
        F.min("gene_id").alias("gene_id"),
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda e: F.concat_ws("-", e["exon_start"].cast("string"), e["exon_end"].cast("string"))), ",").alias("signature"),
    )


def unique_ratios(transcripts: DataFrame, cutoffs: list[int], *, bins: int = 10) -> DataFrame:
    """Per gene of several transcripts and cutoff, the share of transcripts whose last bases no other of the gene has.

    Returns ``gene_id, cutoff, n_transcripts, ratio, bin`` with the ratio's bin of ``bins`` equal ones from 0 to 1.
    """
    found = signature(at_cutoffs(transcripts.where("gene_id is not null"), cutoffs, with_utr=False), by=("cutoff",))
    alike = found.groupBy("gene_id", "cutoff", "signature").agg(F.count(F.lit(1)).alias("n"))
    per_gene = alike.groupBy("gene_id", "cutoff").agg(F.sum("n").alias("n_transcripts"), F.sum((F.col("n") == 1).cast("int")).alias("n_unique"))
    ratio = F.col("n_unique") / F.col("n_transcripts")
    return per_gene.where("n_transcripts > 1").select(
        "gene_id", "cutoff", "n_transcripts", F.round(ratio, 6).alias("ratio"), F.least(F.floor(ratio * bins) + 1, F.lit(bins)).alias("bin")
    )


def chunks_for(exons: DataFrame, chunk_width: int) -> DataFrame:
    """Exons with each number of the genome chunks (of ``chunk_width`` bases, from 0) that they lie in."""
    first, last = F.floor((F.col("exon_start") - 1) / chunk_width), F.floor((F.col("exon_end") - 1) / chunk_width)
    return exons.withColumn("chunk_no", F.explode(F.sequence(first, last)))


def spliced(exons: DataFrame, genome: DataFrame, *, chunk_width: int) -> DataFrame:
    """``transcript_id, sequence``: bases of the exons in ascending order, reverse-complemented on the negative strand.

    ``genome`` has ``contig, chunk_no, chunk_start`` (1-based) and ``bases``; it is joined by (contig, chunk), so it is never
    gathered. Transcripts with an exon outside the genome are left out.
    """
    from tallyloom.functions.sequence import reverse_complement

    wanted = chunks_for(exons, chunk_width)
    start = F.greatest(F.col("exon_start"), F.col("chunk_start"))
    end = F.least(F.col("exon_end"), F.col("chunk_start") + F.length("bases") - 1)
    piece = F.substring("bases", start - F.col("chunk_start") + 1, end - start + 1)
    joined = wanted.join(genome, (wanted["chrom"] == genome["contig"]) & (wanted["chunk_no"] == genome["chunk_no"]), "left").select(
        "transcript_id", "is_negative", "tx_width", F.struct("exon_start", wanted["chunk_no"], piece.alias("bases")).alias("piece")
    )
    whole = joined.groupBy("transcript_id", "is_negative", "tx_width").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    sequence = F.array_join(F.transform("pieces", lambda p: p["bases"]), "")
    return whole.select(
        "transcript_id", F.when(F.col("is_negative"), reverse_complement(sequence)).otherwise(sequence).alias("sequence"), "tx_width"
    ).where(F.length("sequence") == F.col("tx_width")).drop("tx_width")
