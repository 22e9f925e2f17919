"""Queries that evaluate the counts of runs against a second copy of them, and the frames behind reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import evaluate
from tallyloom.operators.counts import histogram, top_by_group
from tallyloom.session import read_table

METRICS = ["assigned_tx", "assigned_gene", "ambiguous", "short"]


def clean_counts(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of counts in one spelling, repeated rows once."""
    strip = lambda c: F.regexp_replace(F.col(c), r"^\s+|\s+$", "")
    return read_table(spark, sf_dir, table).select(
        "run", F.upper(strip("id")).alias("id"), F.lower(strip("id_level")).alias("id_level"), "count", "cpm", F.when(F.col("gene_id") != "", F.col("gene_id")).alias("gene_id")
    ).distinct()


def _pairs(spark: SparkSession, sf_dir: str, how: str = "inner") -> DataFrame:
    """Records of both copies side by side."""
    a = clean_counts(spark, sf_dir, "counts").select("run", "id", "id_level", F.col("count").alias("n"), "cpm", "gene_id")
    b = clean_counts(spark, sf_dir, "counts_copy").select("run", "id", F.col("count").alias("n_copy"), F.col("cpm").alias("cpm_copy"), F.col("gene_id").alias("gene_copy"))
    return a.join(b, ["run", "id"], how)


def pearson_log2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.correlation(_pairs(spark, sf_dir), "n", "n_copy", by=["run", "id_level"])


def pearson_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``pearson_log2``, records missing in the copy counting 0 there."""
    return evaluate.correlation(_pairs(spark, sf_dir, "left"), "n", "n_copy", by=["run"])


def precision_recall_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.precision_recall(_pairs(spark, sf_dir, "left"), "gene_id", "gene_copy", by=["run", "id_level"])


def mean_of_group_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.mean_of_recalls(_pairs(spark, sf_dir, "left"), "gene_id", "gene_copy", by=["run"])


def shared_unique_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lambda t: clean_counts(spark, sf_dir, t).where("count > 0")
    return evaluate.shared_and_unique(known("counts"), known("counts_copy"), ["run"], "id")


def isoform_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts counted in both copies, of genes with at least two of them."""
    of = lambda t: clean_counts(spark, sf_dir, t).where("id_level = 'transcript' and count > 0 and gene_id is not null").select("gene_id", "id")
    shared = of("counts").intersect(of("counts_copy"))
    several = shared.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("gene_id")
    return shared.join(several, "gene_id", "left_semi")


def only_in_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda t: clean_counts(spark, sf_dir, t).select("run", "id")
    return ids("counts").subtract(ids("counts_copy"))


def all_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda t: clean_counts(spark, sf_dir, t).where("id is not null").select("id")
    return ids("counts").union(ids("counts_copy")).distinct()


def union_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = clean_counts(spark, sf_dir, "counts").select("run", "id", "count").withColumn("source", F.lit("counts"))
    b = clean_counts(spark, sf_dir, "counts_copy").select("run", "id", "count", F.round("cpm", 3).alias("cpm")).withColumn("source", F.lit("copy"))
    return a.unionByName(b, allowMissingColumns=True)


def unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean_counts(spark, sf_dir, "counts").select("run", "id", F.col("count").cast("double").alias("count"), F.round("cpm", 3).alias("cpm"))
    return rows.unpivot(["run", "id"], ["count", "cpm"], "metric", "value")


def run_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_counts(spark, sf_dir, "counts").groupBy("run").agg(F.count(F.lit(1)).alias("n")).select("run", "n", *[c.alias(n) for n, c in evaluate.run_parameters().items()])


def count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(clean_counts(spark, sf_dir, "counts"), "count", 0, 1000, 50)


def weighted_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(clean_counts(spark, sf_dir, "counts"), "cpm", 0, 5000, 50, weight="count")


def count_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.spread_of(clean_counts(spark, sf_dir, "counts"), ["run", "id_level"], "count")


def highest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_by_group(clean_counts(spark, sf_dir, "counts").select("run", "id_level", "id", "count"), ["run", "id_level"], "count")


def known_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose id is annotated (semi-join)."""
    tx = read_table(spark, sf_dir, "transcripts").select(F.col("transcript_id").alias("id"))
    return clean_counts(spark, sf_dir, "counts").join(tx, "id", "left_semi").select("run", "id", "count")


def named_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with gene names looked up, the id itself where there is none, missing counts as 0."""
    tx = read_table(spark, sf_dir, "transcripts").select(F.col("transcript_id").alias("id"), F.col("gene_id").alias("annotated"))
    joined = clean_counts(spark, sf_dir, "counts").join(tx, "id", "left")
    return joined.select("run", "id", F.coalesce("annotated", "gene_id", "id").alias("name"), F.coalesce("count", F.lit(0)).alias("count"))


def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_counts(spark, sf_dir, "counts").dropna().groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run with every cutoff and the number of its records above it."""
    rows = clean_counts(spark, sf_dir, "counts").select("run", "count", F.explode(F.array(*[F.lit(c) for c in (0, 10, 100, 1000)])).alias("cutoff"))
    return rows.groupBy("run", "cutoff").agg(F.count_if(F.col("count") > F.col("cutoff")).alias("n"))


def sampled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible sample of 1000 transcripts: those with the smallest hash of their id."""
    return read_table(spark, sf_dir, "transcripts").select("transcript_id", F.md5("transcript_id").alias("h")).orderBy("h", "transcript_id").limit(1000)


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each run, of the kind that reports are made from."""
    level = lambda name: F.sum(F.when((F.col("id_level") == name) & (F.col("n") > 0), F.lit(1)).otherwise(0))
    counted = _pairs(spark, sf_dir, "left").groupBy("run").agg(
        F.count(F.lit(1)).alias("total_reads"), level("transcript").alias("assigned_tx"), level("gene").alias("assigned_gene"),
        F.count_if(F.col("n") == 0).alias("ambiguous"), F.count_if(F.col("n").isNull()).alias("short"),
    )
    return counted.select("*", *[c.alias(n) for n, c in evaluate.run_parameters().items()])


def report_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.rates(run_metrics(spark, sf_dir))


def report_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = evaluate.rates(run_metrics(spark, sf_dir)).where("k is not null and m is not null").select("k", "m", "rep", "assignment_rate_tx")
    return evaluate.above_quantile(rates, "assignment_rate_tx")


def report_heatmap_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``report_heatmap``, for genes."""
    rates = evaluate.rates(run_metrics(spark, sf_dir)).where("k is not null and m is not null").select("k", "m", "rep", "assignment_rate_gene")
    return evaluate.above_quantile(rates, "assignment_rate_gene")


def report_recall_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, by run, of the records counted differently in the copies: whether the copy names their gene; the median passes over nulls."""
    differing = _pairs(spark, sf_dir, "left").where("not (n <=> n_copy)")
    recalls = evaluate.precision_recall(differing, "gene_id", "gene_copy", by=["run"]).select("run", "recall")
    runs = clean_counts(spark, sf_dir, "counts").where("run is not null").select("run").distinct().join(recalls, "run", "left")
    return evaluate.above_quantile(runs.select("run", *[c.alias(n) for n, c in evaluate.run_parameters().items()], "recall"), "recall")


def report_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.long_means(run_metrics(spark, sf_dir), ["k"], METRICS)


def report_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_metrics(spark, sf_dir).dropna()
    means = evaluate.long_means(rows, ["k", "m"], METRICS, name="category")
    return means.withColumn("label", F.format_string("k=%d, m=%d", "k", "m"))


def report_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_by_group(run_metrics(spark, sf_dir).select("k", "run", "assigned_tx"), ["k"], "assigned_tx")


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = evaluate.rates(run_metrics(spark, sf_dir))
    return rates.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("assignment_rate_tx"), 6).alias("mean_rate"), F.round(F.max("assignment_rate_tx"), 6).alias("best_rate"), F.round(F.avg("unassigned_rate"), 6).alias("mean_unassigned")
    )


def report_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each run (rows) and whether it is above the 85th percentile."""
    sizes = clean_counts(spark, sf_dir, "counts").groupBy("run").agg(F.count(F.lit(1)).alias("size"))
    return evaluate.above_quantile(sizes, "size", quantile=0.85)


def report_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the seconds between midnight and each record's writing, by run."""
    seconds = F.hour("written_at") * 3600 + F.minute("written_at") * 60 + F.second("written_at")
    rows = read_table(spark, sf_dir, "counts").where("written_at is not null").select("run", seconds.alias("s"))
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 3).alias("mean"), F.round(F.stddev_samp("s"), 3).alias("sd"))


def report_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log2 counts of both copies, record by record."""
    return _pairs(spark, sf_dir).where("n is not null and n_copy is not null").select("run", "id", F.round(F.log2(F.col("n") + 1), 6).alias("x"), F.round(F.log2(F.col("n_copy") + 1), 6).alias("y"))


def report_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript length and number of minimizers in long form."""
    counted = read_table(spark, sf_dir, "minimizer_paths").where("tx_id is not null and minimizer is not null").groupBy("tx_id").agg(F.count(F.lit(1)).alias("minimizers"))
    lengths = read_table(spark, sf_dir, "transcripts").select(F.col("transcript_id").alias("tx_id"), F.col("tx_len").cast("bigint").alias("length"))
    return counted.join(lengths, "tx_id").unpivot(["tx_id"], ["minimizers", "length"], "metric", "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        pearson_log2, pearson_left, precision_recall_f1, mean_of_group_recalls, shared_unique_counts, isoform_intersect, only_in_counts, all_ids, union_levels, unpivot_metrics,
        run_parameters, count_histogram, weighted_histogram, count_spread, highest_counts, known_genes, named_counts, complete_rows, parameter_grid, sampled_ids, run_metrics,
        report_rates, report_heatmap, report_heatmap_genes, report_recall_heatmap, report_phases, report_distribution, report_best, report_summary, report_sizes, report_times, report_scatter, report_lengths,
    )
    return {f.__name__: f for f in own}


def _clean(table: str) -> str:
    strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return f"""
        SELECT DISTINCT run, upper({strip('id')}) AS id, lower({strip('id_level')}) AS id_level, "count", cpm, nullif(gene_id, '') AS gene_id FROM {table}
    """


CLEAN, COPY = _clean("counts"), _clean("counts_copy")


def _side_by_side(how: str) -> str:
    return f"""
        SELECT a.run, a.id, a.id_level, a."count" AS n, a.cpm, a.gene_id, b."count" AS n_copy, b.cpm AS cpm_copy, b.gene_id AS gene_copy
        FROM ({CLEAN}) AS a {how} JOIN ({COPY}) AS b ON a.run = b.run AND a.id = b.id
    """


def _correlation(source: str, by: str) -> str:
    return f"""
        SELECT {by}, round(CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN corr(CASE WHEN x > -1 THEN log2(x + 1) END, CASE WHEN y > -1 THEN log2(y + 1) END) END, 6) AS r, count(*) AS n, round(CAST(sum(x) AS BIGINT), 3) AS total_x, round(CAST(sum(y) AS BIGINT), 3) AS total_y,
            round(max(greatest(x, y)), 3) AS highest
        FROM (SELECT *, coalesce(n, 0) AS x, coalesce(n_copy, 0) AS y FROM ({source})) GROUP BY {by}
    """


def _parameter(letter: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(run, '{letter}([0-9]+)', 1), '') AS INTEGER)"


PARAMETERS = ", ".join(f"{_parameter(letter)} AS {name}" for name, letter in (("k", "k"), ("m", "m"), ("rep", "r")))
RUN_METRICS = f"""
    SELECT *, {PARAMETERS} FROM (
        SELECT run, count(*) AS total_reads, count(*) FILTER (id_level = 'transcript' AND n > 0) AS assigned_tx, count(*) FILTER (id_level = 'gene' AND n > 0) AS assigned_gene,
            count(*) FILTER (n = 0) AS ambiguous, count(*) FILTER (n IS NULL) AS short
        FROM ({_side_by_side('LEFT')}) GROUP BY run
    )
"""
RATES = f"""
    SELECT *, round(assigned_tx / total_reads, 6) AS assignment_rate_tx, round(assigned_gene / total_reads, 6) AS assignment_rate_gene,
        round((ambiguous + short) / total_reads, 6) AS unassigned_rate FROM ({RUN_METRICS})
"""


def _long_means(group: str, name: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {group}, '{v}' AS {name}, round(avg({v}), 6) AS value FROM ({source}) GROUP BY {group}" for v in METRICS)


def oracle_sql() -> dict[str, str]:
    left = _side_by_side("LEFT")
    bucket = lambda c, high, width: f"CAST(CASE WHEN {c} < 0 THEN 0 WHEN {c} >= {high} THEN 51 ELSE floor({c} / {width}) + 1 END AS BIGINT)"
    return {
        "pearson_log2": _correlation(_side_by_side(""), "run, id_level"),
        "pearson_left": _correlation(left, "run"),
        "precision_recall_f1": f"""
            SELECT *, round(CASE WHEN correct + wrong > 0 THEN correct / (correct + wrong) END, 6) AS precision, round(correct / (correct + wrong + unassigned), 6) AS recall,
                round(CASE WHEN correct > 0 THEN 2 * correct / (2 * correct + 2 * wrong + unassigned) END, 6) AS f1
            FROM (SELECT run, id_level, count(*) FILTER (gene_id = gene_copy) AS correct, count(*) FILTER (gene_id <> gene_copy) AS wrong, count(*) FILTER (gene_copy IS NULL) AS unassigned
                FROM ({left}) WHERE gene_id IS NOT NULL GROUP BY run, id_level)
        """,
        "mean_of_group_recalls": f"""
            SELECT run, count(*) AS n_groups, round(avg(recall), 6) AS mean_recall FROM
                (SELECT run, gene_id, avg(CASE WHEN gene_id = gene_copy THEN 1.0 ELSE 0.0 END) AS recall FROM ({left}) WHERE gene_id IS NOT NULL GROUP BY run, gene_id) GROUP BY run
        """,
        "shared_unique_counts": f"""
            SELECT coalesce(a.run, b.run) AS run, count(*) FILTER (a.run IS NOT NULL AND b.run IS NOT NULL) AS shared, count(*) FILTER (b.run IS NULL) AS only_a, count(*) FILTER (a.run IS NULL) AS only_b
            FROM (SELECT DISTINCT run, id FROM ({CLEAN}) WHERE "count" > 0) AS a FULL JOIN (SELECT DISTINCT run, id FROM ({COPY}) WHERE "count" > 0) AS b ON a.run = b.run AND a.id = b.id GROUP BY 1
        """,
        "isoform_intersect": f"""
            WITH s AS (
                SELECT gene_id, id FROM ({CLEAN}) WHERE id_level = 'transcript' AND "count" > 0 AND gene_id IS NOT NULL
                INTERSECT SELECT gene_id, id FROM ({COPY}) WHERE id_level = 'transcript' AND "count" > 0 AND gene_id IS NOT NULL
            ) SELECT * FROM s WHERE gene_id IN (SELECT gene_id FROM s GROUP BY gene_id HAVING count(*) >= 2)
        """,
        "only_in_counts": f"SELECT run, id FROM ({CLEAN}) EXCEPT SELECT run, id FROM ({COPY})",
        "all_ids": f"SELECT id FROM ({CLEAN}) WHERE id IS NOT NULL UNION SELECT id FROM ({COPY}) WHERE id IS NOT NULL",
        "union_levels": f"""SELECT run, id, "count", 'counts' AS source, NULL::DOUBLE AS cpm FROM ({CLEAN}) UNION ALL SELECT run, id, "count", 'copy', round(cpm, 3) FROM ({COPY})""",
        "unpivot_metrics": f"""SELECT run, id, 'count' AS metric, CAST("count" AS DOUBLE) AS value FROM ({CLEAN}) UNION ALL SELECT run, id, 'cpm', round(cpm, 3) FROM ({CLEAN})""",
        "run_parameters": f"SELECT run, n, {PARAMETERS} FROM (SELECT run, count(*) AS n FROM ({CLEAN}) GROUP BY run)",
        "count_histogram": f"""SELECT {bucket('"count"', 1000, 20)} AS bin, count(*) AS n FROM ({CLEAN}) WHERE "count" IS NOT NULL GROUP BY 1""",
        "weighted_histogram": f"""SELECT {bucket('cpm', 5000, 100)} AS bin, CAST(sum("count") AS BIGINT) AS n FROM ({CLEAN}) WHERE cpm IS NOT NULL GROUP BY 1""",
        "count_spread": f"""
            SELECT run, id_level, count(*) AS n, round(avg(c), 4) AS mean, round(stddev_samp(c), 4) AS sd, min(c) AS lowest, round(quantile_cont(c, 0.5), 4) AS median, round(quantile_cont(c, 0.85), 4) AS q85, max(c) AS highest
            FROM (SELECT run, id_level, "count" AS c FROM ({CLEAN}) WHERE "count" IS NOT NULL) GROUP BY run, id_level
        """,
        "highest_counts": f"""
            SELECT run, id_level, id, "count" FROM (SELECT *, rank() OVER (PARTITION BY run, id_level ORDER BY "count" DESC) AS place FROM ({CLEAN}) WHERE "count" IS NOT NULL) WHERE place = 1
        """,
        "known_genes": f"""SELECT run, id, "count" FROM ({CLEAN}) WHERE id IN (SELECT transcript_id FROM transcripts)""",
        "named_counts": f"""
            SELECT run, id, coalesce(t.gene_id, c.gene_id, id) AS name, coalesce("count", 0) AS "count" FROM ({CLEAN}) AS c LEFT JOIN transcripts AS t ON t.transcript_id = c.id
        """,
        "complete_rows": f"""
            SELECT run, count(*) AS n FROM ({CLEAN}) WHERE run IS NOT NULL AND id IS NOT NULL AND id_level IS NOT NULL AND "count" IS NOT NULL AND cpm IS NOT NULL AND gene_id IS NOT NULL GROUP BY run
        """,
        "parameter_grid": f"""SELECT run, CAST(cutoff AS INTEGER) AS cutoff, count(*) FILTER ("count" > cutoff) AS n FROM ({CLEAN}), unnest([0, 10, 100, 1000]) AS u(cutoff) GROUP BY 1, 2""",
        "sampled_ids": "SELECT transcript_id, md5(transcript_id) AS h FROM transcripts ORDER BY h, transcript_id LIMIT 1000",
        "run_metrics": RUN_METRICS,
        "report_rates": RATES,
        "report_heatmap": f"""
            WITH r AS (SELECT k, m, rep, assignment_rate_tx FROM ({RATES}) WHERE k IS NOT NULL AND m IS NOT NULL)
            SELECT *, assignment_rate_tx > (SELECT median(assignment_rate_tx) FROM r) AS above FROM r
        """,
        "report_heatmap_genes": f"""
            WITH r AS (SELECT k, m, rep, assignment_rate_gene FROM ({RATES}) WHERE k IS NOT NULL AND m IS NOT NULL)
            SELECT *, assignment_rate_gene > (SELECT median(assignment_rate_gene) FROM r) AS above FROM r
        """,
        "report_recall_heatmap": f"""
            WITH d AS (
                SELECT run, round(count(*) FILTER (gene_id = gene_copy) / count(*), 6) AS recall FROM ({left})
                WHERE n IS DISTINCT FROM n_copy AND gene_id IS NOT NULL GROUP BY run
            ), r AS (SELECT run, {PARAMETERS}, recall FROM (SELECT DISTINCT run FROM ({CLEAN}) WHERE run IS NOT NULL) LEFT JOIN d USING (run))
            SELECT *, recall > (SELECT median(recall) FROM r) AS above FROM r
        """,
        "report_phases": _long_means("k", "metric", RUN_METRICS),
        "report_distribution": "SELECT *, 'k=' || k || ', m=' || m AS label FROM ("
        + _long_means("k, m", "category", f"SELECT * FROM ({RUN_METRICS}) WHERE run IS NOT NULL AND k IS NOT NULL AND m IS NOT NULL AND rep IS NOT NULL") + ")",
        "report_best": f"SELECT k, run, assigned_tx FROM (SELECT *, rank() OVER (PARTITION BY k ORDER BY assigned_tx DESC) AS place FROM ({RUN_METRICS})) WHERE place = 1",
        "report_summary": f"SELECT k, count(*) AS n, round(avg(assignment_rate_tx), 6) AS mean_rate, round(max(assignment_rate_tx), 6) AS best_rate, round(avg(unassigned_rate), 6) AS mean_unassigned FROM ({RATES}) GROUP BY k",
        "report_sizes": f"WITH s AS (SELECT run, count(*) AS size FROM ({CLEAN}) GROUP BY run) SELECT *, size > (SELECT quantile_cont(size, 0.85) FROM s) AS above FROM s",
        "report_times": """
            SELECT run, count(*) AS n, round(avg(s), 3) AS mean, round(stddev_samp(s), 3) AS sd
            FROM (SELECT run, hour(written_at) * 3600 + minute(written_at) * 60 + second(written_at) AS s FROM counts WHERE written_at IS NOT NULL) GROUP BY run
        """,
        "report_scatter": f"SELECT run, id, CASE WHEN n > -1 THEN round(log2(n + 1), 6) END AS x, CASE WHEN n_copy > -1 THEN round(log2(n_copy + 1), 6) END AS y FROM ({_side_by_side('')}) WHERE n IS NOT NULL AND n_copy IS NOT NULL",
        "report_lengths": """
            WITH j AS (SELECT tx_id, minimizers, CAST(tx_len AS BIGINT) AS length FROM
                (SELECT tx_id, count(*) AS minimizers FROM minimizer_paths WHERE tx_id IS NOT NULL AND minimizer IS NOT NULL GROUP BY tx_id) JOIN transcripts ON transcript_id = tx_id)
            SELECT tx_id, 'minimizers' AS metric, minimizers AS value FROM j UNION ALL SELECT tx_id, 'length', length FROM j
        """,
    }
