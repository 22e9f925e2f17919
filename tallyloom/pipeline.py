"""The two main jobs: building an index from annotation and genome, and counting reads against it."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.sequence import encode_bases, utr_tail
from tallyloom.operators.annotation import exon_rows, spliced
from tallyloom.operators.assign import assign_reads, run_summary
from tallyloom.operators.counts import counts_by_level, molecule_counts
from tallyloom.operators.index import check_lengths, minimizer_paths, path_triplets, postings
from tallyloom.session import written
from tallyloom.sources import readers, writers

CHUNK_WIDTH = 10_000


def build_index(spark: SparkSession, gtf: str, fasta: str, folder: str, *, k: int, m: int = 8, plus: int = 500) -> DataFrame:
    """Write the index of all transcripts' last bases (3' UTR and ``plus`` before it); returns the transcripts left out.

    Left out are transcripts whose sequence is not in the genome, or is shorter than ``k``, or that have no gene.
    """
    check_lengths(k, m)
    transcripts = readers.transcripts_of(readers.read_gtf(spark, gtf))
    genome = readers.regular_chunks(readers.read_fasta(spark, fasta), CHUNK_WIDTH)
    sequences = spliced(exon_rows(transcripts), genome, chunk_width=CHUNK_WIDTH)
    known = sequences.join(transcripts.select("transcript_id", "gene_id", "utr_len"), "transcript_id").where("gene_id is not null")
    digits = known.select(F.col("transcript_id").alias("tx_id"), encode_bases(utr_tail(F.col("sequence"), F.col("utr_len"), plus)).alias("digits"))
    paths = written(minimizer_paths(digits, "tx_id", "digits", k, m).where(F.size("path") > 0))
    genes = transcripts.select(F.col("transcript_id").alias("tx_id"), "gene_id")
    index = postings(path_triplets(paths, "tx_id"), "tx_id").join(genes, "tx_id")
    writers.write_index(paths.join(genes, "tx_id"), index, folder, k=k, m=m)
    return transcripts.join(paths.select(F.col("tx_id").alias("transcript_id")), "transcript_id", "left_anti").select("transcript_id", "gene_id")


def assigned(spark: SparkSession, reads: DataFrame, folder: str) -> DataFrame:
    """Assignments of reads (``read_id, seq``) against an index, written to the shared folder."""
    k, m, _, index = writers.read_index(spark, folder)
    digits = reads.select("read_id", encode_bases(F.col("seq")).alias("digits"))
    triplets = written(path_triplets(minimizer_paths(digits, "read_id", "digits", k, m), "read_id"))
    return written(assign_reads(reads, triplets, index))


def count_reads(spark: SparkSession, index: str, second: str, out: str, *, first: str | None = None, details: bool = False) -> None:
    """Count reads of FASTQ files: in bulk, or with first reads per barcode with distinct UMIs. Writes counts, summary and, on request, assignments."""
    reads = readers.read_fastq(spark, second)
    unused = 0
    if first:
        reads, unused = readers.paired(reads, readers.read_fastq(spark, first))
    reads = written(reads)
    found = assigned(spark, reads, index)
    writers.write_summary(run_summary(found), f"{out}/summary")
    if details:
        writers.write_assignments(found, f"{out}/read_assignments.tsv")
    if not first:
        writers.write_counts(counts_by_level(found), f"{out}/counts.tsv")
        return
    if unused:
        print(f"{unused} first reads have no second read")
    barred = found.join(reads.select("read_id", "barcode", "umi"), "read_id")
    of = lambda level, c: molecule_counts(
        barred.where(F.col(c).isNotNull()).withColumn("feature", F.col(c)), barcode="barcode", feature=["feature"], umi="umi"
    ).withColumn("level", F.lit(level))
    counts = of("gene", "gene_id").unionByName(of("transcript", "tx_id"))
    writers.write_matrix(counts, reads.select("barcode"), out, feature="feature", level="level", barcode="barcode")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tallyloom")
    jobs = parser.add_subparsers(dest="job", required=True)
    index = jobs.add_parser("index", help="build an index")
    for name in ("gtf", "fasta", "index"):
        index.add_argument(f"--{name}", required=True)
    index.add_argument("-k", type=int, required=True)
    index.add_argument("-m", type=int, default=8)
    count = jobs.add_parser("count", help="count reads against an index")
    for name in ("index", "second", "out"):
        count.add_argument(f"--{name}", required=True)
    count.add_argument("--first")
    count.add_argument("--details", action="store_true")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tallyloom").getOrCreate()
    if given.job == "index":
        left_out = build_index(spark, given.gtf, given.fasta, given.index, k=given.k, m=given.m)
        print(f"{left_out.count()} transcripts are not in the index")
    else:
        count_reads(spark, given.index, given.second, given.out, first=given.first, details=given.details)
