"""A walk over the loci at which two alignments of the same reads disagree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom.operators.graph import pairs_sharing, read_states
from tallyloom.operators.intervals import overlap_join, periods_and_gaps
from tallyloom.session import shared_folder, written

PLACE = ["contig", "start", "end"]


def _named(loci: DataFrame) -> DataFrame:
    return loci.withColumn("locus", F.concat(F.col("contig"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))


def _at(loci: DataFrame, features: DataFrame, member: str) -> DataFrame:
    """``locus, <member>``: what of ``features`` overlaps each locus."""
    found = features.select(F.col("contig").alias("__contig"), F.col("start").alias("__start"), F.col("end").alias("__end"), F.col(member).alias("__of"))
    pairs = overlap_join(loci.select("locus", *PLACE), found, left_on=tuple(PLACE), right_on=("__contig", "__start", "__end"))
    return pairs.select("locus", F.col("__of").alias(member)).where(F.col(member).isNotNull()).distinct()


def _unbarred(targets: DataFrame, frontier: DataFrame, genes: DataFrame | None, links: DataFrame | None, repeats: DataFrame | None) -> DataFrame:
    """Targets (``source`` and a place) without those that are paralogous to their source or share a repeat class with it."""
    both = _named(targets).select("source", *PLACE, F.col("locus").alias("target"))
    loci = frontier.select("locus", *PLACE).union(both.select(F.col("target").alias("locus"), *PLACE)).distinct()
    if genes is not None and links is not None:
        at = written(_at(loci, genes, "gene"))
        linked = at.join(links.select(F.col("a").alias("gene"), F.col("b")), "gene").select(F.col("locus").alias("source"), F.col("b").alias("gene")).distinct()
        barred = both.select("source", "target").distinct().join(linked, "source").join(at.withColumnRenamed("locus", "target"), ["target", "gene"], "left_semi")
        both = both.join(barred.select("source", "target").distinct(), ["source", "target"], "left_anti")
    if repeats is not None:
        shared = pairs_sharing(both.select("source", "target").distinct(), _at(loci, repeats, "repeat_class"), left="source", right="target", locus="locus", member="repeat_class")
        both = both.join(shared.where("shares").select("source", "target"), ["source", "target"], "left_anti")
    return both.select("source", *PLACE)


def discrepancies(
    a: DataFrame, b: DataFrame, seeds: DataFrame, *, padding: int = 0, genes: DataFrame | None = None, links: DataFrame | None = None, repeats: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Loci where alignments ``a`` and ``b`` place different reads, from the ``seeds`` on, and the state of these reads.

    ``a`` and ``b`` have ``read, contig, start, end, good``; seeds, ``genes`` (with ``gene``) and ``repeats`` (with ``repeat_class``)
    have a half-open place as well, ``links`` are ``symmetric_edges`` of genes. Returns

    * ``contig, start, end, step, n_a, n_b, only_a, only_b``: each locus met, its good reads in a and b, and those of one side only;
    * ``read, side, state``: reads that only ``side`` has at some locus, and what the other alignment has of them (``read_states``).

    A step takes all loci of the last one: of reads that only one side has there, the good places in the other alignment that lie
    beyond ``padding`` of all known loci are merged (within ``padding``) to the loci of the next step. The walk ends when there are none.
    Places paralogous to the locus they were reached from, or of the same repeat class, are not gone to from it. As each step takes its
    whole frontier, loci need no order. Rows with nulls in their place are nowhere, null reads nobody; a null ``good`` is not good.
    Loci and reads lie in one folder, a part of it for each step, so that the plan of a step does not grow with their number.
    """
    spark, folder = a.sparkSession, f"{shared_folder(a.sparkSession)}/tallyloom-{uuid.uuid4().hex}"
    sides = {s: df.select("read", *PLACE, F.coalesce("good", F.lit(False)).alias("good")) for s, df in (("a", a), ("b", b))}
    good = {s: df.where("good and read is not null and contig is not null and start is not null and end > start").drop("good") for s, df in sides.items()}
    known = lambda: spark.read.schema("contig string, start bigint, end bigint, locus string, step int").parquet(f"{folder}/loci")
    placed = lambda: spark.read.schema("locus string, read string, in_a boolean, in_b boolean, step int").parquet(f"{folder}/reads")

    def kept(loci: DataFrame, step: int) -> int:
        seen = Observation()
        whole = loci.select("contig", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"))
        _named(whole).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/loci/step={step}")
        return seen.get["n"]

    step, n = 0, kept(seeds.select(*PLACE).where("contig is not null and start is not null and end > start").distinct(), 0)
    if not n:
        counts = ", ".join(f"{name} bigint" for name in ("n_a", "n_b", "only_a", "only_b"))
        return spark.createDataFrame([], f"contig string, start bigint, end bigint, step int, {counts}"), spark.createDataFrame([], "read string, side string, state string")
    while n:
        frontier = known().where(F.col("step") == step)
        here = {s: _at(frontier, df.withColumn("read", F.col("read").cast("string")), "read").withColumn(f"in_{s}", F.lit(True)) for s, df in good.items()}
        here["a"].join(here["b"], ["locus", "read"], "full").write.parquet(f"{folder}/reads/step={step}")
        of_step = placed().where(F.col("step") == step)
        lone = of_step.where("in_b is null").select("read", F.col("locus").alias("source")).join(good["b"], "read").union(
            of_step.where("in_a is null").select("read", F.col("locus").alias("source")).join(good["a"], "read"))
        targets = lone.select("source", *PLACE).distinct()
        around = known().select(F.col("contig").alias("k_contig"), (F.col("start") - padding).alias("k_start"), (F.col("end") + padding).alias("k_end"))
        beyond = overlap_join(targets, around, left_on=tuple(PLACE), right_on=("k_contig", "k_start", "k_end"), how="left").where("k_contig is null").select("source", *PLACE)
        if genes is not None or repeats is not None:
            beyond = _unbarred(written(beyond), frontier, genes, links, repeats)
        widened = beyond.select("contig", "start", (F.col("end") + padding).alias("end")).distinct()
        ahead = periods_and_gaps(widened, *PLACE).where("kind = 'period'").select(F.col("entity").alias("contig"), F.col("from_pos").alias("start"), (F.col("to_pos") - padding).alias("end"))
        step, n = step + 1, kept(ahead, step + 1)
    count_if = lambda condition, name: F.count_if(condition).alias(name)
    tally = placed().groupBy("locus").agg(count_if("in_a", "n_a"), count_if("in_b", "n_b"), count_if(F.col("in_b").isNull(), "only_a"), count_if(F.col("in_a").isNull(), "only_b"))
    loci = known().join(tally, "locus", "left").fillna(0, ["n_a", "n_b", "only_a", "only_b"])
    of = lambda s, o: read_states(placed().where(F.col(f"in_{o}").isNull()), sides[o], read="read", good="good").withColumn("side", F.lit(s))
    return loci.select(*PLACE, "step", "n_a", "n_b", "only_a", "only_b"), of("a", "b").unionByName(of("b", "a")).select("read", "side", "state")
