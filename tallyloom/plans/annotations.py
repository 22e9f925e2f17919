"""Queries on annotation: exons, last bases, interval joins and coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import annotation
from tallyloom.operators.counts import top_by_group
from tallyloom.operators.graph import resolved_loci
from tallyloom.operators.intervals import best_overlap, depth_segments, merged_loci, overlap_join, periods_and_gaps
from tallyloom.operators.layers import touches_by_layer
from tallyloom.operators.simulate import simulated_counts as simulate
from tallyloom.session import read_table, written

#: The cutoffs of the coverage counts; those of the unique ratios (100 to 1000) are among them.
CUTOFFS = list(range(100, 2001, 100))


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "transcripts")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable intervals, each of its kind once."""
    rows = read_table(spark, sf_dir, "bed_entries").where("chrom is not null and chromstart >= 0 and chromend > chromstart")
    return rows.select(F.lower(F.regexp_replace("chrom", r"^\s+|\s+$", "")).alias("chrom"), "chromstart", "chromend", "name", "strand").distinct()


def running_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotation.exon_rows(_transcripts(spark, sf_dir))
    return rows.select("transcript_id", "exon_start", "exon_end", "width", "number", "width_before", "tx_width")


def exon_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotation.exon_rows(_transcripts(spark, sf_dir))
    along = Window.partitionBy("transcript_id").orderBy("exon_start", "exon_end")
    return rows.select("transcript_id", "exon_start", F.lag("exon_end", 1, 0).over(along).alias("previous_end"))


def gene_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transcript with its gene's total width kept per row."""
    rows = _transcripts(spark, sf_dir).where("gene_id is not null")
    totals = rows.groupBy("gene_id").agg(F.sum("tx_len").alias("gene_len"), F.count(F.lit(1)).alias("n_transcripts"))
    return rows.select("transcript_id", "gene_id", "tx_len").join(totals, "gene_id")


def lengths_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of exons and UTRs, added up from one row for each feature."""
    rows = _transcripts(spark, sf_dir)
    exons = rows.select("transcript_id", "gene_id", F.explode("exons").alias("e")).select("transcript_id", "gene_id", F.lit("exon").alias("feature"), F.col("e.exon_start").alias("start"), F.col("e.exon_end").alias("end"))
    utrs = rows.where("utr_len > 0").select("transcript_id", "gene_id", F.lit("three_prime_utr").alias("feature"), F.lit(1).alias("start"), F.col("utr_len").alias("end"))
    return annotation.lengths_by_type(exons.union(utrs))


def last_k_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.last_bases(_transcripts(spark, sf_dir), 400).select("transcript_id", "exon_start", "exon_end", "width")


def bed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.bed_rows(annotation.last_bases(_transcripts(spark, sf_dir), 400))


def unique_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.unique_ratios(_transcripts(spark, sf_dir), CUTOFFS)


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.signature(annotation.exon_rows(_transcripts(spark, sf_dir)))


def longest_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _transcripts(spark, sf_dir).select("gene_id", "transcript_id", "tx_len").where("gene_id is not null")
    return top_by_group(rows, ["gene_id"], "tx_len")


def stranded_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir).withColumn("place", F.concat_ws(" ", "chrom", F.coalesce("strand", F.lit("."))))
    found = periods_and_gaps(rows, "place", "chromstart", "chromend").where("kind = 'period'")
    return found.select(F.col("entity").alias("place"), "from_pos", "to_pos")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _transcripts(spark, sf_dir).where("chrom is not null and tx_start is not null and tx_end >= tx_start")
    return rows.select(F.lower("chrom").alias("tx_chrom"), (F.col("tx_start") - 1).alias("tx_from"), F.col("tx_end").alias("tx_to"), "transcript_id", "gene_id")


def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap_join(_entries(spark, sf_dir), _spans(spark, sf_dir), left_on=("chrom", "chromstart", "chromend"), right_on=("tx_chrom", "tx_from", "tx_to"))
    shared = F.least("chromend", "tx_to") - F.greatest("chromstart", "tx_from")
    return pairs.select("chrom", "chromstart", "chromend", "name", "strand", "transcript_id", shared.alias("shared"), F.round(shared / (F.col("chromend") - F.col("chromstart")), 6).alias("fraction"))


def overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap_pairs(spark, sf_dir)
    return pairs.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("shared").alias("bases"))


def uncovered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that lie in no transcript (left overlap join without a partner)."""
    pairs = overlap_join(_entries(spark, sf_dir), _spans(spark, sf_dir), left_on=("chrom", "chromstart", "chromend"), right_on=("tx_chrom", "tx_from", "tx_to"), how="left")
    return pairs.where("transcript_id is null").select("chrom", "chromstart", "chromend", "name", "strand")


def best_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir).select("chrom", "chromstart", "chromend").distinct().withColumn("entry", F.concat_ws(":", "chrom", F.col("chromstart").cast("string"), F.col("chromend").cast("string")))
    return best_overlap(entries, _spans(spark, sf_dir), left_id="entry", right_id="transcript_id", left_on=("chrom", "chromstart", "chromend"), right_on=("tx_chrom", "tx_from", "tx_to"), padding=500)


def _merged_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cutoff, on_chrom, from_pos, to_pos``: the last bases of all transcripts at each cutoff, merged."""
    tails = annotation.at_cutoffs(_transcripts(spark, sf_dir).where("chrom is not null"), CUTOFFS).select(
        F.concat_ws("/", F.col("cutoff").cast("string"), F.lower("chrom")).alias("place"), (F.col("exon_start") - 1).alias("s"), F.col("exon_end").alias("e")
    )
    return periods_and_gaps(tails, "place", "s", "e").where("kind = 'period'").select(
        F.substring_index("entity", "/", 1).cast("int").alias("cutoff"), F.expr("substring(entity, instr(entity, '/') + 1)").alias("on_chrom"), "from_pos", "to_pos"
    )


def coverage_by_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cutoff, how many intervals touch the merged last bases of all transcripts."""
    tails = annotation.at_cutoff_runs(_transcripts(spark, sf_dir).where("chrom is not null"), CUTOFFS).select(
        F.lower("chrom").alias("place"), (F.col("exon_start") - 1).alias("s"), F.col("exon_end").alias("e"), "first", "last"
    )
    hits = touches_by_layer(tails, _entries(spark, sf_dir), spans_on=("place", "s", "e"), reads_on=("chrom", "chromstart", "chromend"), first="first", last="last", n_layers=len(CUTOFFS))
    return hits.select(F.element_at(F.array(*map(F.lit, CUTOFFS)), F.col("layer") + 1).alias("cutoff"), F.col("entity").alias("chrom"), "n_hits")


def coverage_by_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cutoff and each stretch of merged last bases, how many intervals touch it; 0 where none does."""
    merged = written(_merged_tails(spark, sf_dir))
    hits = overlap_join(_entries(spark, sf_dir), merged, left_on=("chrom", "chromstart", "chromend"), right_on=("on_chrom", "from_pos", "to_pos"))
    stretch = ["cutoff", "on_chrom", "from_pos", "to_pos"]
    counted = merged.join(hits.groupBy(*stretch).agg(F.count(F.lit(1)).alias("n")), stretch, "left")
    return counted.select("cutoff", F.col("on_chrom").alias("chrom"), "from_pos", "to_pos", F.coalesce("n", F.lit(0)).alias("n_hits"))


def region_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals by chrom and region: within an exon, else within a transcript, else between genes."""
    entries = _entries(spark, sf_dir).select("chrom", "chromstart", "chromend").distinct()
    exons = annotation.exon_rows(_transcripts(spark, sf_dir)).select(F.lower("chrom").alias("exon_chrom"), (F.col("exon_start") - 1).alias("exon_from"), F.col("exon_end").alias("exon_to")).distinct()
    spans = _spans(spark, sf_dir).select("tx_chrom", "tx_from", "tx_to").distinct()
    key = ["chrom", "chromstart", "chromend"]
    on = ("chrom", "chromstart", "chromend")
    in_exon = overlap_join(entries, exons, left_on=on, right_on=("exon_chrom", "exon_from", "exon_to")).select(*key).distinct().withColumn("in_exon", F.lit(True))
    in_span = overlap_join(entries, spans, left_on=on, right_on=("tx_chrom", "tx_from", "tx_to")).select(*key).distinct().withColumn("in_span", F.lit(True))
    region = F.when(F.col("in_exon"), "exon").when(F.col("in_span"), "intron").otherwise("intergenic")
    return entries.join(in_exon, key, "left").join(in_span, key, "left").groupBy("chrom", region.alias("region")).agg(F.count(F.lit(1)).alias("n"))


def id_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read_table(spark, sf_dir, "counts").where("id is not null").select(F.upper(F.trim("id")).alias("id"))
    return resolved_loci(ids, _transcripts(spark, sf_dir), key="id")


def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many positions of each chrom are covered how often."""
    segments = depth_segments(_entries(spark, sf_dir), "chrom", "chromstart", "chromend")
    return segments.groupBy(F.col("entity").alias("chrom"), "depth").agg(F.sum(F.col("to_pos") - F.col("from_pos")).alias("positions"))


def padded_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_loci(_entries(spark, sf_dir), "chrom", "chromstart", "chromend", padding=500).withColumnRenamed("entity", "chrom")


def strand_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs by whether interval and transcript are on the same strand."""
    pairs = overlap_pairs(spark, sf_dir).where("strand is not null").join(_transcripts(spark, sf_dir).select("transcript_id", "is_negative"), "transcript_id")
    same = F.col("strand") == F.when(F.col("is_negative"), "-").otherwise("+")
    counted = pairs.groupBy("chrom").agg(F.count_if(same).alias("same"), F.count_if(~same).alias("opposite"))
    return counted.withColumn("share", F.round(F.col("same") / (F.col("same") + F.col("opposite")), 6))


def body_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs by the hundredth of the transcript, in its direction, in which the middle of the interval lies."""
    spans = _transcripts(spark, sf_dir).select("transcript_id", "tx_start", "tx_end", "is_negative")
    pairs = overlap_pairs(spark, sf_dir).join(spans, "transcript_id")
    middle = F.floor((F.greatest("chromstart", F.col("tx_start") - 1) + F.least("chromend", "tx_end")) / 2) - (F.col("tx_start") - 1)
    length = F.col("tx_end") - F.col("tx_start") + 1
    along = F.when(F.col("is_negative"), length - 1 - middle).otherwise(middle)
    return pairs.groupBy(F.floor(along * 100 / length).alias("hundredth")).agg(F.count(F.lit(1)).alias("n"))


def junction_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct exon junctions of the transcripts within each growing tenth of the ids (by hash)."""
    along = Window.partitionBy("transcript_id").orderBy("exon_start", "exon_end")
    rows = annotation.exon_rows(_transcripts(spark, sf_dir)).select("transcript_id", "chrom", F.lag("exon_end").over(along).alias("donor"), F.col("exon_start").alias("acceptor")).where("donor is not null")
    tenth = F.conv(F.substring(F.md5("transcript_id"), 1, 4), 16, 10).cast("int") % 10 + 1
    first = rows.groupBy("chrom", "donor", "acceptor").agg(F.min(tenth).alias("tenth"))
    per_tenth = first.groupBy("tenth").agg(F.count(F.lit(1)).alias("n_new"))
    return per_tenth.withColumn("n_so_far", F.sum("n_new").over(Window.orderBy("tenth").rowsBetween(Window.unboundedPreceding, 0)))  # ten rows


def simulated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate(_transcripts(spark, sf_dir), "transcript_id", low=10, high=1000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        running_width, exon_gaps, gene_widths, lengths_by_feature, last_k_trim, bed_rows, unique_ratios, signatures, longest_transcripts, stranded_periods, overlap_pairs,
        overlap_counts, uncovered_entries, best_transcripts, coverage_by_cutoff, coverage_by_interval, region_distribution, id_loci,
        depth_histogram, padded_loci, strand_shares, body_coverage, junction_saturation, simulated_counts,
    )
    return {f.__name__: f for f in own}


EXONS = """
    SELECT transcript_id, gene_id, chrom, is_negative, coalesce(utr_len, 0) AS utr_len, exon_start, exon_end, exon_end - exon_start + 1 AS width,
        CAST(sum(exon_end - exon_start + 1) OVER (PARTITION BY transcript_id) AS BIGINT) AS tx_width, CAST(row_number() OVER w AS INTEGER) AS number,
        CAST(coalesce(sum(exon_end - exon_start + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS width_before
    FROM (SELECT transcript_id, gene_id, chrom, is_negative, utr_len, unnest(exons, recursive := true) FROM transcripts)
    WINDOW w AS (PARTITION BY transcript_id ORDER BY CASE WHEN is_negative THEN -exon_start ELSE exon_start END, exon_end)
"""


def _last(k: int, utr: bool = True) -> str:
    excess = f"greatest(tx_width - ({k} + {'utr_len' if utr else '0'}) - width_before, 0)"
    return f"""
        SELECT transcript_id, gene_id, chrom, is_negative, CASE WHEN is_negative THEN exon_start ELSE exon_start + cut END AS exon_start,
            CASE WHEN is_negative THEN exon_end - cut ELSE exon_end END AS exon_end, width - cut AS width
        FROM (SELECT *, {excess} AS cut FROM ({EXONS})) WHERE cut < width
    """


ENTRIES = r"""
    SELECT DISTINCT lower(regexp_replace(chrom, '^\s+|\s+$', '', 'g')) AS chrom, chromstart, chromend, name, strand FROM bed_entries
    WHERE chrom IS NOT NULL AND chromstart >= 0 AND chromend > chromstart
"""
SPANS = """
    SELECT lower(chrom) AS tx_chrom, tx_start - 1 AS tx_from, tx_end AS tx_to, transcript_id, gene_id FROM transcripts
    WHERE chrom IS NOT NULL AND tx_start IS NOT NULL AND tx_end >= tx_start
"""
OVERLAPS = f"""
    SELECT e.*, t.transcript_id, least(chromend, tx_to) - greatest(chromstart, tx_from) AS shared
    FROM ({ENTRIES}) AS e JOIN ({SPANS}) AS t ON chrom = tx_chrom AND chromstart < tx_to AND tx_from < chromend
"""


def _merged(source: str, place: str) -> str:
    return f"""
        SELECT place, min(s) AS from_pos, max(e) AS to_pos FROM (
            SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY place ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
            FROM (SELECT *, max(e) OVER (PARTITION BY place ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
                FROM (SELECT DISTINCT {place} AS place, CAST(chromstart AS BIGINT) AS s, CAST(chromend AS BIGINT) AS e FROM ({source})))
        ) GROUP BY place, island
    """


def oracle_sql() -> dict[str, str]:
    alike = " UNION ALL ".join(
        f"SELECT {k} AS cutoff, transcript_id, min(gene_id) AS gene_id, string_agg(exon_start || '-' || exon_end, ',' ORDER BY exon_start, exon_end) AS sig"
        f" FROM ({_last(k, utr=False)}) WHERE gene_id IS NOT NULL GROUP BY transcript_id" for k in CUTOFFS
    )
    bed = "SELECT chrom, exon_start - 1 AS chromstart, exon_end AS chromend, transcript_id AS name, 0 AS score, CASE WHEN is_negative THEN '-' ELSE '+' END AS strand FROM ({})"
    tails = " UNION ALL ".join(f"SELECT {k} AS cutoff, * FROM ({_merged(bed.format(_last(k)), 'lower(chrom)')})" for k in CUTOFFS)
    return {
        "running_width": f"SELECT transcript_id, exon_start, exon_end, width, number, width_before, tx_width FROM ({EXONS})",
        "exon_gaps": f"SELECT transcript_id, exon_start, lag(exon_end, 1, 0) OVER (PARTITION BY transcript_id ORDER BY exon_start, exon_end) AS previous_end FROM ({EXONS})",
        "lengths_by_feature": """
            SELECT transcript_id, gene_id, CAST(coalesce(list_sum(list_transform(exons, lambda e: e.exon_end - e.exon_start + 1)), 0) AS BIGINT) AS tx_len,
                CAST(greatest(coalesce(utr_len, 0), 0) AS BIGINT) AS utr_len FROM transcripts WHERE len(exons) > 0 OR utr_len > 0
        """,
        "gene_widths": """
            SELECT transcript_id, gene_id, tx_len, CAST(sum(tx_len) OVER (PARTITION BY gene_id) AS BIGINT) AS gene_len, count(*) OVER (PARTITION BY gene_id) AS n_transcripts
            FROM transcripts WHERE gene_id IS NOT NULL
        """,
        "last_k_trim": f"SELECT transcript_id, exon_start, exon_end, width FROM ({_last(400)})",
        "bed_rows": bed.format(_last(400)),
        "unique_ratios": f"""
            WITH alike AS (SELECT gene_id, cutoff, sig, count(*) AS n FROM ({alike}) GROUP BY 1, 2, 3),
            per_gene AS (SELECT gene_id, cutoff, CAST(sum(n) AS BIGINT) AS n_transcripts, count(*) FILTER (n = 1) AS n_unique FROM alike GROUP BY 1, 2)
            SELECT gene_id, cutoff, n_transcripts, round(n_unique / n_transcripts, 6) AS ratio, CAST(least(floor(n_unique / n_transcripts * 10) + 1, 10) AS BIGINT) AS bin
            FROM per_gene WHERE n_transcripts > 1
        """,
        "signatures": f"SELECT transcript_id, min(gene_id) AS gene_id, string_agg(exon_start || '-' || exon_end, ',' ORDER BY exon_start, exon_end) AS signature FROM ({EXONS}) GROUP BY transcript_id",
        "longest_transcripts": """
            SELECT gene_id, transcript_id, tx_len FROM (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY tx_len DESC) AS place FROM transcripts WHERE gene_id IS NOT NULL AND tx_len IS NOT NULL)
            WHERE place = 1
        """,
        "stranded_periods": _merged(ENTRIES, "chrom || ' ' || coalesce(strand, '.')"),
        "overlap_pairs": f"SELECT chrom, chromstart, chromend, name, strand, transcript_id, shared, round(shared / (chromend - chromstart), 6) AS fraction FROM ({OVERLAPS})",
        "overlap_counts": f"SELECT transcript_id, count(*) AS n_entries, CAST(sum(shared) AS BIGINT) AS bases FROM ({OVERLAPS}) GROUP BY transcript_id",
        "uncovered_entries": f"SELECT * FROM ({ENTRIES}) AS e WHERE NOT EXISTS (SELECT 1 FROM ({SPANS}) WHERE chrom = tx_chrom AND chromstart < tx_to AND tx_from < chromend)",
        "best_transcripts": f"""
            SELECT entry, transcript_id, shared FROM (
                SELECT *, row_number() OVER (PARTITION BY entry ORDER BY shared DESC, transcript_id) AS place FROM (
                    SELECT chrom || ':' || chromstart || ':' || chromend AS entry, transcript_id, least(chromend, tx_to + 500) - greatest(chromstart, tx_from - 500) AS shared
                    FROM (SELECT DISTINCT chrom, chromstart, chromend FROM ({ENTRIES})) JOIN ({SPANS}) ON chrom = tx_chrom AND chromstart < tx_to + 500 AND tx_from - 500 < chromend
                )
            ) WHERE place = 1
        """,
        "coverage_by_cutoff": f"""
            SELECT cutoff, place AS chrom, count(*) AS n_hits FROM ({tails}) JOIN ({ENTRIES}) ON chrom = place AND chromstart < to_pos AND from_pos < chromend GROUP BY 1, 2
        """,
        "coverage_by_interval": f"""
            SELECT cutoff, place AS chrom, from_pos, to_pos, count(chromstart) AS n_hits
            FROM ({tails}) LEFT JOIN ({ENTRIES}) ON chrom = place AND chromstart < to_pos AND from_pos < chromend GROUP BY ALL
        """,
        "region_distribution": f"""
            SELECT chrom, CASE WHEN EXISTS (SELECT 1 FROM ({EXONS}) AS x WHERE lower(x.chrom) = e.chrom AND x.exon_start - 1 < e.chromend AND e.chromstart < x.exon_end) THEN 'exon'
                WHEN EXISTS (SELECT 1 FROM ({SPANS}) WHERE tx_chrom = e.chrom AND tx_from < e.chromend AND e.chromstart < tx_to) THEN 'intron' ELSE 'intergenic' END AS region, count(*) AS n
            FROM (SELECT DISTINCT chrom, chromstart, chromend FROM ({ENTRIES})) AS e GROUP BY 1, 2
        """,
        "depth_histogram": f"""
            WITH steps AS (
                SELECT chrom, pos, sum(step) AS step FROM (
                    SELECT chrom, chromstart AS pos, 1 AS step FROM ({ENTRIES}) UNION ALL SELECT chrom, chromend, -1 FROM ({ENTRIES})) GROUP BY 1, 2
            ), segments AS (
                SELECT chrom, lead(pos) OVER w - pos AS n, sum(step) OVER (w ROWS UNBOUNDED PRECEDING) AS depth FROM steps WINDOW w AS (PARTITION BY chrom ORDER BY pos)
            ) SELECT chrom, CAST(depth AS BIGINT) AS depth, CAST(sum(n) AS BIGINT) AS positions FROM segments WHERE depth > 0 GROUP BY 1, 2
        """,
        "padded_loci": f"""
            WITH m AS (SELECT place, from_pos, to_pos - 500 AS to_pos FROM ({_merged(f"SELECT chrom, chromstart, chromend + 500 AS chromend FROM ({ENTRIES})", "chrom")}))
            SELECT place AS chrom, from_pos, to_pos, count(*) AS n_reads FROM m JOIN ({ENTRIES}) AS e ON e.chrom = place AND chromstart < to_pos AND from_pos < chromend GROUP BY 1, 2, 3
        """,
        "strand_shares": f"""
            SELECT *, round(same / (same + opposite), 6) AS share FROM (
                SELECT o.chrom, count(*) FILTER (strand = s) AS same, count(*) FILTER (strand <> s) AS opposite
                FROM ({OVERLAPS}) AS o JOIN (SELECT transcript_id, CASE WHEN is_negative THEN '-' ELSE '+' END AS s FROM transcripts) USING (transcript_id) WHERE strand IS NOT NULL GROUP BY 1)
        """,
        "body_coverage": f"""
            SELECT CAST(floor((CASE WHEN is_negative THEN n - 1 - mid ELSE mid END) * 100 / n) AS BIGINT) AS hundredth, count(*) AS n FROM (
                SELECT is_negative, tx_end - tx_start + 1 AS n, floor((greatest(chromstart, tx_start - 1) + least(chromend, tx_end)) / 2) - (tx_start - 1) AS mid
                FROM ({OVERLAPS}) AS o JOIN transcripts USING (transcript_id)) GROUP BY 1
        """,
        "junction_saturation": f"""
            WITH j AS (SELECT transcript_id, chrom, lag(exon_end) OVER (PARTITION BY transcript_id ORDER BY exon_start, exon_end) AS donor, exon_start AS acceptor FROM ({EXONS})),
            f AS (SELECT chrom, donor, acceptor, min(CAST('0x' || substr(md5(transcript_id), 1, 4) AS INTEGER) % 10 + 1) AS tenth FROM j WHERE donor IS NOT NULL GROUP BY 1, 2, 3),
            t AS (SELECT tenth, count(*) AS n_new FROM f GROUP BY 1)
            SELECT tenth, n_new, CAST(sum(n_new) OVER (ORDER BY tenth) AS BIGINT) AS n_so_far FROM t
        """,
        "id_loci": """
            WITH ids AS (SELECT DISTINCT upper(trim(id)) AS id FROM counts WHERE id IS NOT NULL),
            g AS (SELECT gene_id AS id, min(chrom) AS chrom, min(tx_start) AS s, max(tx_end) AS e FROM transcripts WHERE gene_id IS NOT NULL GROUP BY 1)
            SELECT ids.id, CASE WHEN t.chrom IS NOT NULL THEN t.chrom ELSE g.chrom END AS chrom,
                CASE WHEN t.chrom IS NOT NULL THEN t.tx_start ELSE g.s END AS start, CASE WHEN t.chrom IS NOT NULL THEN t.tx_end ELSE g.e END AS "end"
            FROM ids LEFT JOIN transcripts AS t ON t.transcript_id = ids.id LEFT JOIN g ON g.id = ids.id
        """,
    }
