"""Groups of linked genes, walks over linked loci, and the states of reads that two alignments disagree on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom.session import Written, shared_folder

#: Nodes that are broadcast as hubs at most, and the pairs that a node needs to be one at least.
MOST_HUBS = 100_000
LEAST_HUB = 100_000


def symmetric_edges(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Each link in both directions once, without nulls and links to itself: columns ``a, b``."""
    links = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    return links.union(links.select("b", "a")).distinct()


def with_lowest(pairs: DataFrame, lowest: DataFrame, n_rows: int) -> DataFrame:
    """``node, other, lowest`` of pairs (``node, other``) and the ``lowest`` of each node (``node, degree, lowest``).

    Nodes of more than ``n_rows / MOST_HUBS`` pairs are hubs: they are fewer than ``MOST_HUBS``, and broadcast, so that their pairs
    stay where they are. All others are joined by shuffle. There are none where all pairs are fewer than a hub needs.
    """
    if n_rows <= LEAST_HUB:
        return pairs.join(lowest.select("node", "lowest"), "node").select("node", "other", "lowest")
    is_hub = F.col("degree") > max(LEAST_HUB, n_rows // MOST_HUBS)
    hubs = lowest.where(is_hub).select("node", F.col("lowest").alias("hub_lowest"))
    split = pairs.join(F.broadcast(hubs), "node", "left")
    at_hubs = split.where("hub_lowest is not null").select("node", "other", F.col("hub_lowest").alias("lowest"))
    elsewhere = split.where("hub_lowest is null").join(lowest.where(~is_hub).select("node", "lowest"), "node")
    return at_hubs.union(elsewhere.select("node", "other", "lowest"))


def link_groups(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``node, label``: nodes of the links with the smallest node reachable from them, by spreading minimal labels.

    A round gives each node the least label among itself, its neighbours, and the label of its label; rounds go on until no
    label changes. It is meant for link tables of short paths such as paralog lists. Nodes of one label meet in the last join; they
    are its left side, which adaptive execution splits where it is skewed.
    """
    edges = Written(symmetric_edges(rows, a, b))
    state = Written(edges.df.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        labels = state.df.select("node", "label")
        near = edges.df.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        joined = labels.join(near, "node", "left").join(jump, "label", "left")
        least = F.least("label", F.coalesce("near", "label"), F.coalesce("further", "label"))
        after = Written(joined.select("node", least.alias("label"), F.col("label").alias("before")), changed=F.count_if(F.col("label") < F.col("before")))
        state.drop()
        state = after
        if not after.values["changed"]:
            edges.drop()
            return state.df.select("node", "label")


def regrouped(counts: DataFrame, groups: DataFrame, *, key: str, value: str) -> DataFrame:
    """``label, <value>``: counts summed by the group of their key; a key without a group is its own."""
    renamed = groups.select(F.col("node").alias(key), "label")
    return counts.join(renamed, key, "left").groupBy(F.coalesce("label", key).alias("label")).agg(F.sum(value).alias(value))


def reachable(seeds: DataFrame, links: DataFrame, *, node: str, a: str, b: str) -> DataFrame:
    """``node, step``: what can be reached from the seeds over directed links, with the number of the step it is first met in.

    Frontier by frontier: neighbours of the last frontier that were not met before are the next one, until there are none. All that
    is met lies in one folder, a part of it for each step, so the plan of a step does not grow with their number.
    """
    spark, kind = seeds.sparkSession, dict(seeds.dtypes)[node]
    folder = f"{shared_folder(spark)}/tallyloom-{uuid.uuid4().hex}"
    edges = Written(links.select(F.col(a).alias("from_node"), F.col(b).alias("node")).where("from_node is not null and node is not null").distinct())
    frontier, step = seeds.select(F.col(node).alias("node")).where("node is not null").distinct(), 0
    while True:
        seen = Observation()
        frontier.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/step={step}")
        met = spark.read.schema(f"node {kind}, step int").parquet(folder)
        if not seen.get["n"]:
            return met
        ahead = met.where(F.col("step") == step).select(F.col("node").alias("from_node")).join(edges.df, "from_node").select("node").distinct()
        frontier, step = ahead.join(met.select("node"), "node", "left_anti"), step + 1


def priority_frontier(loci: DataFrame, *, reads: str, locus: str) -> DataFrame:
    """Loci by falling number of reads, ties by name: the order in which a walk takes them up."""
    return loci.orderBy(F.desc(reads), locus)


def mapping_differences(a: DataFrame, b: DataFrame, *, locus: str, read: str) -> DataFrame:
    """``<locus>, <read>, side``: reads that only alignment a (or only b) has at a locus."""
    left, right = a.select(locus, read).distinct(), b.select(locus, read).distinct()
    return left.join(right, [locus, read], "left_anti").withColumn("side", F.lit("a")).unionByName(
        right.join(left, [locus, read], "left_anti").withColumn("side", F.lit("b"))
    )


def read_states(differences: DataFrame, other: DataFrame, *, read: str, good: str) -> DataFrame:
    """``<read>, state`` of reads missing in the other alignment.

    ``mapped_elsewhere`` if the other alignment has the read with good quality at any locus, else ``filtered`` if it has the
    read at all, else ``not_present``. Of several rows of a read the first of these holds.
    """
    seen = other.groupBy(read).agg(F.max(F.coalesce(F.col(good), F.lit(False))).alias("__good"))
    state = F.when(F.col("__good"), "mapped_elsewhere").when(~F.col("__good"), "filtered").otherwise("not_present")
    return differences.select(read).distinct().join(seen, read, "left").select(read, state.alias("state"))


def usable_alignments(alignments: DataFrame, *, least_quality: int = 255, longest_intron: int = 15_000) -> DataFrame:
    """Mapped primary alignments of sufficient quality without an intron (operation 3) longer than ``longest_intron``.

    ``alignments`` has ``mapq``, ``flag`` and ``cigar`` (array of op, len); a null cigar has no introns.
    """
    unmapped_or_secondary = F.col("flag").bitwiseAND(F.lit(0x4 | 0x100 | 0x800)) != 0
    long_intron = F.coalesce(F.exists("cigar", lambda c: (c["op"] == 3) & (c["len"] > longest_intron)), F.lit(False))
    return alignments.where((F.col("mapq") >= least_quality) & ~unmapped_or_secondary & ~long_intron)


def resolved_loci(ids: DataFrame, transcripts: DataFrame, *, key: str) -> DataFrame:
    """``<key>, chrom, start, end``: an id's span, as a transcript if it is one, else as a gene; null where it is neither."""
    tx = transcripts.groupBy(F.col("transcript_id").alias(key)).agg(F.min("chrom").alias("tc"), F.min("tx_start").alias("ts"), F.max("tx_end").alias("te"))
    genes = transcripts.where("gene_id is not null").groupBy(F.col("gene_id").alias(key)).agg(
        F.min("chrom").alias("gc"), F.min("tx_start").alias("gs"), F.max("tx_end").alias("ge")
    )
    joined = ids.select(key).distinct().join(tx, key, "left").join(genes, key, "left")
    pick = lambda t, g: F.when(F.col("tc").isNotNull(), F.col(t)).otherwise(F.col(g))
    return joined.select(key, pick("tc", "gc").alias("chrom"), pick("ts", "gs").alias("start"), pick("te", "ge").alias("end"))


def linked_pairs(pairs: DataFrame, links: DataFrame, *, left: str, right: str) -> DataFrame:
    """Adds ``linked`` to pairs of genes: whether one is listed with the other (columns ``a, b`` of ``symmetric_edges``)."""
    known = links.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.lit(True).alias("__linked"))
    joined = pairs.join(known, (F.col(left) == F.col("__a")) & (F.col(right) == F.col("__b")), "left")
    return joined.select(*pairs.columns, F.coalesce("__linked", F.lit(False)).alias("linked"))


def pairs_sharing(pairs: DataFrame, members: DataFrame, *, left: str, right: str, locus: str, member: str) -> DataFrame:
    """Adds ``shares`` to pairs of loci: whether any member (a repeat class, say) is found at both."""
    of = members.select(F.col(locus).alias("__locus"), F.col(member).alias("__member")).where("__member is not null").distinct()
    a = pairs.select(left, right).distinct().join(of, F.col(left) == F.col("__locus")).select(left, right, "__member")
    common = a.join(of, (F.col(right) == F.col("__locus")) & (a["__member"] == of["__member"]), "left_semi")
    found = common.select(F.col(left).alias("__left"), F.col(right).alias("__right")).distinct().withColumn("__shares", F.lit(True))
    joined = pairs.join(found, (F.col(left) == F.col("__left")) & (F.col(right) == F.col("__right")), "left")
    return joined.select(*pairs.columns, F.coalesce("__shares", F.lit(False)).alias("shares"))
