"""Queries on linked genes: lists taken apart, symmetric links, groups, remapped counts, walks and read states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import evaluate, graph
from tallyloom.operators.intervals import neighbours
from tallyloom.operators.walk import discrepancies
from tallyloom.plans.evaluation import CLEAN, COPY, clean_counts
from tallyloom.session import read_table


def _gene(column: str):
    """A gene id in upper case without version; null if it is none."""
    return F.nullif(F.regexp_extract(F.upper(F.col(column)), r"^\s*(MQG[0-9]{9})(?:\.\S*)?\s*$", 1), F.lit(""))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "paralogs").select("gene", F.explode(F.split("paralogs", ",")).alias("paralog"))
    return rows.select(_gene("gene").alias("gene"), _gene("paralog").alias("paralog"))


def paralog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).where("gene is not null and paralog is not null and gene <> paralog").groupBy("gene", "paralog").agg(F.count(F.lit(1)).alias("n"))


def symmetric_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symmetric_edges(_links(spark, sf_dir), "gene", "paralog")


def paralog_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gene with its paralogs as one sorted comma list, as the list files have them."""
    lists = symmetric_links(spark, sf_dir).groupBy(F.col("a").alias("gene")).agg(F.array_join(F.array_sort(F.collect_list("b")), ",").alias("paralogs"))
    return lists


def paralog_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.link_groups(_links(spark, sf_dir), "gene", "paralog")


def grouped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene counts of both copies summed by paralog group."""
    groups = paralog_groups(spark, sf_dir)
    of = lambda t: clean_counts(spark, sf_dir, t).where("id_level = 'gene' and id is not null").groupBy("id").agg(F.sum("count").alias("n"))
    a = graph.regrouped(of("counts"), groups, key="id", value="n")
    b = graph.regrouped(of("counts_copy"), groups, key="id", value="n").withColumnRenamed("n", "n_copy")
    return a.join(b, "label", "full")


def grouped_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the logarithms of both copies' counts by paralog group, over groups that both have."""
    both = grouped_counts(spark, sf_dir).where("n is not null and n_copy is not null")
    return evaluate.correlation(both, "n", "n_copy")


def discrepancy_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes reached over paralog links from those whose counts differ between the copies, with the step they are met in."""
    of = lambda t: clean_counts(spark, sf_dir, t).where("id_level = 'gene'").select("run", "id", "count")
    seeds = of("counts").join(of("counts_copy").withColumnRenamed("count", "other"), ["run", "id"]).where("not (count <=> other)").select("id")
    return graph.reachable(seeds, symmetric_links(spark, sf_dir), node="id", a="a", b="b")


def _placements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Two alignments of transcripts (their intervals and their exons), the loci of those counted differently in the copies, and genes."""
    place = F.lower(F.regexp_replace("chrom", r"^\s+|\s+$", "")).alias("contig")
    a = read_table(spark, sf_dir, "bed_entries").where("chromstart >= 0").select(
        F.col("name").alias("read"), place, F.col("chromstart").cast("bigint").alias("start"), F.col("chromend").cast("bigint").alias("end"), F.col("strand").isNotNull().alias("good"))
    tx = read_table(spark, sf_dir, "transcripts")
    b = tx.select(F.col("transcript_id").alias("read"), place, F.explode("exons").alias("e"), F.col("gene_id").isNotNull().alias("good")).select(
        "read", "contig", (F.col("e.exon_start") - 1).cast("bigint").alias("start"), F.col("e.exon_end").cast("bigint").alias("end"), "good")
    of = lambda t: clean_counts(spark, sf_dir, t).where("id_level = 'transcript'").select("run", "id", "count")
    ids = of("counts").join(of("counts_copy").withColumnRenamed("count", "other"), ["run", "id"]).where("not (count <=> other)").select("id")
    seeds = graph.resolved_loci(ids, tx, key="id").select(F.lower("chrom").alias("contig"), (F.col("start") - 1).alias("start"), "end")
    genes = tx.where("gene_id is not null").groupBy(F.col("gene_id").alias("gene"), place).agg((F.min("tx_start") - 1).alias("start"), F.max("tx_end").alias("end"))
    return a, b, seeds, genes


def discrepancy_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci met on a walk over those where intervals and exons place different transcripts, paralogous places left out."""
    a, b, seeds, genes = _placements(spark, sf_dir)
    return discrepancies(a, b, seeds, padding=100, genes=genes, links=symmetric_links(spark, sf_dir))[0]


def discrepancy_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transcripts that one side alone places at a locus of ``discrepancy_loci``, and what the other side has of them."""
    a, b, seeds, genes = _placements(spark, sf_dir)
    return discrepancies(a, b, seeds, padding=100, genes=genes, links=symmetric_links(spark, sf_dir))[1]


def missing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ids that only one copy counts in a run: whether the other counts them in another run, has them uncounted, or not at all."""
    of = lambda t: clean_counts(spark, sf_dir, t).where("id is not null")
    counted = lambda t: of(t).where("count > 0").select("run", "id")
    differences = graph.mapping_differences(counted("counts"), counted("counts_copy"), locus="run", read="id").where("side = 'a'")
    return graph.read_states(differences, of("counts_copy").withColumn("good", F.col("count") > 0), read="id", good="good")


def _compared_neighbours(spark: SparkSession, sf_dir: str, tx: DataFrame, entity: str) -> DataFrame:
    """Each gene with the next one of its ``entity``, and whether the two are paralogs or share any minimizer, at all positions."""
    pairs = neighbours(tx, entity, "tx_start", "gene_id").withColumnRenamed("entity", entity)
    paths = read_table(spark, sf_dir, "minimizer_paths").where("minimizer is not null").select(F.col("tx_id").alias("transcript_id"), F.upper("minimizer").alias("minimizer"))
    members = paths.join(tx.select("transcript_id", "gene_id"), "transcript_id").select("gene_id", "minimizer").distinct()
    linked = graph.linked_pairs(pairs, symmetric_links(spark, sf_dir), left="left", right="right")
    return graph.pairs_sharing(linked, members, left="left", right="right", locus="gene_id", member="minimizer")


def gene_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gene with the next one on its chrom."""
    tx = read_table(spark, sf_dir, "transcripts").where("gene_id is not null")
    return _compared_neighbours(spark, sf_dir, tx, "chrom")


def linked_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gene with the next one on the same strand of its chrom (a null strand is the forward one)."""
    tx = read_table(spark, sf_dir, "transcripts").where("gene_id is not null")
    strand = F.concat("chrom", F.when(F.col("is_negative"), "-").otherwise("+"))
    return _compared_neighbours(spark, sf_dir, tx.withColumn("strand", strand), "strand")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (paralog_entries, symmetric_links, paralog_lists, paralog_groups, grouped_counts, grouped_correlation, discrepancy_walk, discrepancy_loci, discrepancy_reads, missing_states, linked_neighbours, gene_neighbours)
    return {f.__name__: f for f in own}


_ID = r"nullif(regexp_extract(upper({}), '^\s*(MQG[0-9]{{9}})([.]\S*)?\s*$', 1), '')"
LINKS = f"SELECT {_ID.format('gene')} AS gene, {_ID.format('paralog')} AS paralog FROM (SELECT gene, unnest(string_split(paralogs, ',')) AS paralog FROM paralogs)"
PAIRS = f"SELECT gene AS a, paralog AS b FROM ({LINKS}) WHERE gene IS NOT NULL AND paralog IS NOT NULL AND gene <> paralog"
SYMMETRIC = f"SELECT a, b FROM ({PAIRS}) UNION SELECT b, a FROM ({PAIRS})"
GROUPS = f"""
    WITH RECURSIVE edges AS ({SYMMETRIC}), reached(node, label) USING KEY (node) AS (
        SELECT DISTINCT a, a FROM edges
        UNION
        SELECT e.b, min(r.label) FROM reached AS r JOIN edges AS e ON e.a = r.node JOIN recurring.reached AS old ON old.node = e.b WHERE r.label < old.label GROUP BY e.b
    ) SELECT node, label FROM reached
"""


def oracle_sql() -> dict[str, str]:
    by_group = lambda source, name: f"""
        SELECT coalesce(g.label, c.id) AS label, CAST(sum(n) AS BIGINT) AS {name}
        FROM (SELECT id, sum("count") AS n FROM ({source}) WHERE id_level = 'gene' AND id IS NOT NULL GROUP BY id) AS c LEFT JOIN grp AS g ON g.node = c.id GROUP BY 1
    """  # noqa: E731
    compared = lambda entity, name="chrom": f"""
        WITH genes AS (SELECT gene_id, {entity} AS {name}, min(tx_start) AS start FROM transcripts WHERE gene_id IS NOT NULL AND chrom IS NOT NULL AND tx_start IS NOT NULL GROUP BY 1, 2),
        pairs AS (SELECT * FROM (SELECT {name}, gene_id AS "left", lead(gene_id) OVER (PARTITION BY {name} ORDER BY start, gene_id) AS "right" FROM genes) WHERE "right" IS NOT NULL),
        members AS (SELECT DISTINCT gene_id, upper(minimizer) AS m FROM minimizer_paths JOIN transcripts ON transcript_id = tx_id WHERE minimizer IS NOT NULL AND gene_id IS NOT NULL),
        sharing AS (SELECT DISTINCT "left", "right" FROM pairs JOIN members AS x ON x.gene_id = "left" JOIN members AS y ON y.gene_id = "right" AND y.m = x.m)
        SELECT {name}, "left", "right", ("left", "right") IN (SELECT (a, b) FROM ({SYMMETRIC})) AS linked, ("left", "right") IN (SELECT ("left", "right") FROM sharing) AS shares FROM pairs
    """  # noqa: E731
    grouped = f"""
        WITH grp AS ({GROUPS}) SELECT coalesce(a.label, b.label) AS label, n, n_copy FROM ({by_group(CLEAN, 'n')}) AS a FULL JOIN ({by_group(COPY, 'n_copy')}) AS b ON a.label = b.label
    """
    return {
        "grouped_correlation": f"""
            SELECT round(corr(CASE WHEN n > -1 THEN log2(n + 1) END, CASE WHEN n_copy > -1 THEN log2(n_copy + 1) END), 6) AS r, count(*) AS n,
                CAST(sum(n) AS BIGINT) AS total_x, CAST(sum(n_copy) AS BIGINT) AS total_y, max(greatest(n, n_copy)) AS highest FROM ({grouped}) AS g WHERE g.n IS NOT NULL AND g.n_copy IS NOT NULL
        """,
        "paralog_entries": f"SELECT a AS gene, b AS paralog, count(*) AS n FROM ({PAIRS}) GROUP BY 1, 2",
        "symmetric_links": SYMMETRIC,
        "paralog_lists": f"SELECT a AS gene, string_agg(b, ',' ORDER BY b) AS paralogs FROM ({SYMMETRIC}) GROUP BY a",
        "paralog_groups": GROUPS,
        "grouped_counts": grouped,
        "discrepancy_walk": f"""
            WITH RECURSIVE edges AS ({SYMMETRIC}), seeds AS (
                SELECT DISTINCT a.id FROM (SELECT * FROM ({CLEAN}) WHERE id_level = 'gene') AS a JOIN (SELECT * FROM ({COPY}) WHERE id_level = 'gene') AS b ON a.run = b.run AND a.id = b.id
                WHERE a."count" IS DISTINCT FROM b."count" AND a.id IS NOT NULL
            ), met(node, step) USING KEY (node) AS (
                SELECT id, 0 FROM seeds
                UNION
                SELECT e.b, min(m.step) + 1 FROM met AS m JOIN edges AS e ON e.a = m.node WHERE NOT EXISTS (SELECT 1 FROM recurring.met AS old WHERE old.node = e.b) GROUP BY e.b
            ) SELECT node, step FROM met
        """,
        "gene_neighbours": compared("chrom"),
        "linked_neighbours": compared("chrom || CASE WHEN is_negative THEN '-' ELSE '+' END", "strand"),
        "missing_states": f"""
            WITH d AS (
                SELECT DISTINCT id FROM (
                    SELECT run, id FROM ({CLEAN}) WHERE "count" > 0 AND id IS NOT NULL EXCEPT SELECT run, id FROM ({COPY}) WHERE "count" > 0 AND id IS NOT NULL)
            ), o AS (SELECT id, bool_or(coalesce("count" > 0, false)) AS good FROM ({COPY}) WHERE id IS NOT NULL GROUP BY id)
            SELECT d.id, CASE WHEN o.good THEN 'mapped_elsewhere' WHEN NOT o.good THEN 'filtered' ELSE 'not_present' END AS state FROM d LEFT JOIN o ON o.id = d.id
        """,
    }
