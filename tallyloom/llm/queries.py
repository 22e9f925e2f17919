"""Queries of this package over the given tables, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.components import connected_components
from tallyloom.llm.distinct import IdentifierDictionary, common_counts, distinct_bitmaps, distinct_counts
from tallyloom.llm.frequency import marked, term_frequencies
from tallyloom.llm.leaks import leaked_spans, without_leaks
from tallyloom.llm.packing import COST_SHARE, container_loads, pack_items, token_counts
from tallyloom.llm.subjects import subject_posteriors
from tallyloom.session import read_table, shared_folder, written


def gene_number(column: str):
    """The number in a gene id: ``MQG`` and nine digits, in any case, with blanks around or a version after a dot; else null."""
    digits = F.regexp_extract(F.upper(F.col(column)), r"^\s*MQG([0-9]{9})(?:\.[^\s]*)?\s*$", 1)
    return F.when(digits != "", digits).cast("bigint")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "paralogs")
    listed = rows.select("gene", F.explode_outer(F.split("paralogs", ",")).alias("paralog"))
    links = written(listed.select(gene_number("gene").alias("gene"), gene_number("paralog").alias("paralog")))
    groups = connected_components(links, "gene", "paralog")
    return groups.select(F.format_string("MQG%09d", "component").alias("group_gene"), F.format_string("MQG%09d", "node").alias("gene"))


def _minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = read_table(spark, sf_dir, "minimizer_paths").where("tx_id is not null and minimizer is not null")
    return paths.select("tx_id", F.translate(F.upper("minimizer"), "N", "G").alias("minimizer"))


def p3_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = _minimizers(spark, sf_dir)
    transcripts = usable.select(F.count_distinct("tx_id")).first()[0]
    return marked(term_frequencies(usable, "minimizer", "tx_id"), transcripts).withColumnRenamed("term", "minimizer")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_frequencies(spark, sf_dir).where("mark is not null").select("minimizer", "mark")


def _identifier(column: str):
    upper = F.upper(F.col(column))
    return F.when(upper != "UNKNOWN", upper)


PARTS = ["day", "slide", "lane"]
IDENTIFIERS = {"barcode": ["barcode"], "umi": ["umi"], "barcode_umi": ["barcode", "umi"]}


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "barcode_umi").select(
        F.to_date("read_at").alias("day"), "slide", "lane", _identifier("barcode").alias("barcode"), _identifier("umi").alias("umi")
    )


def p5_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_counts(distinct_bitmaps(_reads(spark, sf_dir), PARTS, IDENTIFIERS), PARTS)


def _two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps of two runs, lanes 1 and 2 first, all others later, that share a kept dictionary."""
    reads, path = _reads(spark, sf_dir), f"{shared_folder(spark)}/tallyloom-{uuid.uuid4().hex}"
    early = F.coalesce(F.col("lane") <= 2, F.lit(False))
    runs = [distinct_bitmaps(reads.where(of), PARTS, IDENTIFIERS, dictionary=IdentifierDictionary(spark, list(IDENTIFIERS), path=path)) for of in (early, ~early)]
    return runs[0].union(runs[1])


def p5_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_counts(_two_runs(spark, sf_dir), PARTS)


def p5_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers found both in lanes 1 or 2 and in any other lane."""
    return common_counts(_two_runs(spark, sf_dir), "lane <= 2", "lane > 2 or lane is null")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_items(token_counts(read_table(spark, sf_dir, "documents"), "doc_id", "text")).withColumnRenamed("item", "doc_id")


def p7_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: mails packed, containers that break a limit, mails split without need, and whether 98 % of the room is used."""
    packed = written(p7_containers(spark, sf_dir))
    loads = container_loads(packed)
    over = loads.agg(
        F.count_if(F.col("n_tokens") > 2048).alias("n_over_tokens"), F.count_if(F.col("n_places") > 64).alias("n_over_places"),
        F.count_if((F.col("cost") > COST_SHARE * 2048**2) & (F.col("n_places") > 1)).alias("n_over_cost"),
        (F.sum("n_tokens") >= 0.98 * 2048 * F.count(F.lit(1))).alias("well_filled"),
    )
    mails = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("n_tokens"), F.max("to_token").alias("last"))
    split = mails.agg(F.count(F.lit(1)).alias("n_mails"), F.count_if((F.col("n") > 1) & (F.col("n_tokens") <= 2048)).alias("n_split_in_vain"), F.count_if(F.col("n_tokens") != F.col("last")).alias("n_incomplete"))
    return split.join(over)  # one row each


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = leaked_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))
    return spans.select("doc_id", "item_id").distinct()


def p8_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text parts of mails with leaks of 20 words or more, or over a twentieth of the part, cut out."""
    documents = read_table(spark, sf_dir, "documents")
    return without_leaks(documents, leaked_spans(documents, read_table(spark, sf_dir, "eval_items")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = [r.subject for r in read_table(spark, sf_dir, "subject_areas").where("subject is not null").orderBy("subject").collect()]
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "subject_labels")
    judged = subject_posteriors(documents, labels, subjects, sender="from_addr", lang="lang")
    return judged.where("posterior >= 0.5").select("doc_id", "subject").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": p2_found, "p3_found": p3_found, "p3_frequencies": p3_frequencies, "p5_distinct": p5_distinct, "p5_merged": p5_merged, "p5_common": p5_common,
        "p7_containers": p7_containers, "p7_limits": p7_limits, "p8_found": p8_found, "p8_removed": p8_removed, "p9_found": p9_found,
    }


FREQUENCIES = """
    WITH usable AS (
        SELECT tx_id, replace(upper(minimizer), 'N', 'G') AS minimizer FROM minimizer_paths
        WHERE tx_id IS NOT NULL AND minimizer IS NOT NULL
    ), counted AS (
        SELECT minimizer, count(*) AS n_occurrences, count(DISTINCT tx_id) AS n_records FROM usable GROUP BY minimizer
    )
    SELECT minimizer, n_occurrences, n_records,
        CASE WHEN n_records < 3 THEN 'rare'
            WHEN n_records >= 0.01 * (SELECT count(DISTINCT tx_id) FROM usable) THEN 'common' END AS mark
    FROM counted
"""


READS = """
    WITH reads AS (
        SELECT CAST(read_at AS DATE) AS day, slide, lane, nullif(upper(barcode), 'UNKNOWN') AS barcode, nullif(upper(umi), 'UNKNOWN') AS umi
        FROM barcode_umi
    )
"""


def oracle_sql() -> dict[str, str]:
    parts = PARTS
    subsets = [parts, ["day", "slide"], ["day", "lane"], ["slide", "lane"], ["day"], ["slide"], ["lane"], []]
    kinds = {"barcode": "barcode", "umi": "umi", "barcode_umi": "CASE WHEN barcode IS NOT NULL AND umi IS NOT NULL THEN barcode || ' ' || umi END"}
    counted = " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, '{'+'.join(s) or 'all'}' AS \"by\", "
        + ", ".join(f"{p} AS {p}" if p in s else f"NULL::{'DATE' if p == 'day' else 'VARCHAR' if p == 'slide' else 'INTEGER'} AS {p}" for p in parts)
        + f", count(DISTINCT {of}) AS n_distinct FROM reads"
        + (f" GROUP BY {', '.join(s)} HAVING count({of}) > 0" if s else f" HAVING count({of}) > 0")
        for kind, of in kinds.items() for s in subsets
    )
    common = " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, count(*) AS n_common FROM (SELECT {of} FROM reads WHERE lane <= 2 AND {of} IS NOT NULL"
        f" INTERSECT SELECT {of} FROM reads WHERE (lane > 2 OR lane IS NULL) AND {of} IS NOT NULL) HAVING count(*) > 0"
        for kind, of in kinds.items()
    )
    return {
        "p2_found": """
            WITH RECURSIVE listed AS (
                SELECT upper(trim(gene)) AS gene, upper(trim(paralog)) AS paralog
                FROM (SELECT gene, unnest(CASE WHEN paralogs IS NULL THEN [NULL] ELSE string_split(paralogs, ',') END) AS paralog FROM paralogs)
            ), ids AS (
                SELECT nullif(regexp_extract(gene, '^(MQG[0-9]{9})([.].*)?$', 1), '') AS gene,
                    nullif(regexp_extract(paralog, '^(MQG[0-9]{9})([.].*)?$', 1), '') AS paralog
                FROM listed
            ), edges AS (
                SELECT gene AS a, paralog AS b FROM ids WHERE gene IS NOT NULL AND paralog IS NOT NULL
                UNION SELECT paralog, gene FROM ids WHERE gene IS NOT NULL AND paralog IS NOT NULL
            ), nodes AS (
                SELECT gene AS node FROM ids WHERE gene IS NOT NULL UNION SELECT paralog FROM ids WHERE paralog IS NOT NULL
            ), reached(node, low) USING KEY (node) AS (
                SELECT node, node FROM nodes
                UNION
                SELECT e.b, min(r.low) FROM reached AS r JOIN edges AS e ON e.a = r.node
                    JOIN recurring.reached AS old ON old.node = e.b
                WHERE r.low < old.low GROUP BY e.b
            )
            SELECT low AS group_gene, node AS gene FROM reached
        """,
        "p3_frequencies": FREQUENCIES,
        "p3_found": f"SELECT minimizer, mark FROM ({FREQUENCIES}) WHERE mark IS NOT NULL",
        "p7_limits": """
            SELECT count(*) AS n_mails, 0 AS n_split_in_vain, 0 AS n_incomplete, 0 AS n_over_tokens, 0 AS n_over_places, 0 AS n_over_cost, true AS well_filled
            FROM documents
        """,
        "p5_distinct": f"{READS} {counted}",
        "p5_merged": f"{READS} {counted}",
        "p5_common": f"{READS} {common}",
    }
