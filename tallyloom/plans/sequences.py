"""Queries on sequences: codes, k-mers, minimizer paths, the inverted index and read assignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import sequence as seq
from tallyloom.operators import index
from tallyloom.operators.assign import assign_reads, run_summary
from tallyloom.operators.counts import counts_by_level, histogram, rolling_sum
from tallyloom.session import read_table, written

K, M, TAIL, GENES = 16, 8, 500, 7


def _minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "minimizer_paths").where("tx_id is not null and minimizer is not null")


def _barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = read_table(spark, sf_dir, "barcode_umi").where("length(barcode) = 27")
    return reads.select(F.upper("barcode").alias("barcode")).distinct()


def seq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minimizers(spark, sf_dir).select("minimizer").distinct().select("minimizer", seq.encode_bases(F.col("minimizer")).alias("digits"))


def minimizer_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = _minimizers(spark, sf_dir).select(seq.encode_bases(F.col("minimizer")).alias("digits")).distinct()
    number = seq.digits_to_number(F.col("digits"))
    return digits.select(number.alias("number"), seq.number_to_bases(number, 11).alias("bases"))


def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _barcodes(spark, sf_dir).select("barcode", seq.reverse_complement(F.col("barcode")).alias("reversed"))


def barcode_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kmers = _barcodes(spark, sf_dir).select(F.explode(seq.kmers(F.col("barcode"), 20)).alias("kmer"))
    return kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def barcode_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = _barcodes(spark, sf_dir).select("barcode", seq.encode_bases(F.col("barcode")).alias("digits"))
    paths = index.minimizer_paths(digits, "barcode", "digits", 20, 8)
    return paths.select("barcode", F.posexplode("path").alias("pos", "minimizer"))


def first_read_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = F.concat("barcode", "umi")
    sliced = read_table(spark, sf_dir, "barcode_umi").select(seq.barcode_of(read).alias("barcode"), seq.umi_of(read).alias("umi"))
    return sliced.groupBy("barcode", "umi").agg(F.count(F.lit(1)).alias("n"))


def quality_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = read_table(spark, sf_dir, "barcode_umi").where("length(umi) = 16").select(F.explode(seq.window_sums(seq.phred_scores(F.col("umi")), 8)).alias("total"))
    return histogram(strings, "total", 250, 450, 20)


def rolling_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _minimizers(spark, sf_dir).where("pos is not null").select("tx_id", "pos").distinct()
    return rolling_sum(rows, "tx_id", ["pos"], "pos", 5)


def triplet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _minimizers(spark, sf_dir).where("pos is not null").select("tx_id", "pos", F.translate(F.upper("minimizer"), "N", "G").alias("minimizer"))
    return index.row_triplets(rows, "tx_id", "pos", "minimizer")


def postings_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = read_table(spark, sf_dir, "transcripts").select(F.col("transcript_id").alias("tx_id"), "gene_id")
    return index.postings(triplet_rows(spark, sf_dir), "tx_id").join(genes, "tx_id")


def posting_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = index.postings(triplet_rows(spark, sf_dir), "tx_id").groupBy("a").agg(F.count(F.lit(1)).alias("n_postings"), F.count_distinct("b", "c").alias("n_triplets"))
    return sized.withColumn("mean_size", F.round(F.col("n_postings") / F.col("n_triplets"), 6))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on the sizes of all postings."""
    return index.posting_stats(index.postings(triplet_rows(spark, sf_dir), "tx_id"))


def minimizers_per_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _minimizers(spark, sf_dir).groupBy("tx_id").agg(F.count(F.lit(1)).alias("n_minimizers"), F.count_distinct("minimizer").alias("n_distinct"))
    lengths = read_table(spark, sf_dir, "transcripts").select(F.col("transcript_id").alias("tx_id"), "tx_len")
    return counted.join(lengths, "tx_id", "left")


def path_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths without successive repetitions (run collapse)."""
    rows = _minimizers(spark, sf_dir).where("pos is not null").select("tx_id", "pos", F.translate(F.upper("minimizer"), "N", "G").alias("minimizer")).distinct()
    before = F.lag("minimizer").over(Window.partitionBy("tx_id").orderBy("pos", "minimizer"))
    return rows.withColumn("before", before).where("before is null or before <> minimizer").drop("before")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "eval_items")
    return items.select(F.col("item_id").alias("tx_id"), (F.col("item_id") % GENES).alias("gene_id"), seq.encode_letters(F.col("text")).alias("digits"))


def item_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ``TAIL`` letters of each item; the index has whole items."""
    return _items(spark, sf_dir).withColumn("digits", seq.tail(F.col("digits"), TAIL))


def item_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    triplets = index.path_triplets(index.minimizer_paths(items, "tx_id", "digits", K, M), "tx_id")
    return index.postings(triplets, "tx_id").join(items.select("tx_id", "gene_id"), "tx_id")


def assign_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reads against evaluation items as transcripts, whole texts."""
    documents = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), seq.encode_letters(F.col("text")).alias("digits"))
    triplets = index.path_triplets(index.minimizer_paths(documents, "read_id", "digits", K, M), "read_id")
    known = written(item_index(spark, sf_dir))
    # triplets that no transcript has decide nothing but that a read is not short; one of each read is kept for that
    flagged = triplets.join(known.select("a", "b", "c", F.lit(True).alias("hit")).distinct(), ["a", "b", "c"], "left")
    kept = written(flagged.where("hit or pos = 1").drop("hit"))
    return assign_reads(documents.select("read_id"), kept, known)


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_summary(assign_documents(spark, sf_dir)).unpivot([], ["reads", "assigned_tx", "assigned_gene", "ambiguous", "short", "heuristic_tx", "heuristic_gene", "scored_tx", "scored_gene"], "counter", "n")


def count_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_by_level(assign_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        seq_encode, minimizer_numbers, reverse_complement, barcode_kmers, barcode_paths, first_read_slices, quality_windows, rolling_positions,
        triplet_rows, postings_index, posting_stats, index_stats, minimizers_per_transcript, path_runs, item_tails, item_index, assign_documents, run_counters, count_levels,
    )
    return {f.__name__: f for f in own}


def _path_sql(source: str, key: str, digits: str, k: int, m: int) -> str:
    """CTEs ``path(key, pos, v)``: minimizers of each sequence of digits in order, as numbers, without repetitions."""
    number = " + ".join(f"lead(c, {j}) OVER w * {4 ** (m - 1 - j)}" for j in range(m))
    return f"""
        bases AS (
            SELECT {key}, n, unnest(l) AS c, generate_subscripts(l, 1) AS i FROM (
                SELECT {key}, len({digits}) AS n, list_transform(string_split({digits}, ''), lambda x: CAST(x AS BIGINT)) AS l FROM {source} WHERE len({digits}) >= {k}
            )
        ), windows AS (
            SELECT {key}, n, i, {number} AS x FROM bases WINDOW w AS (PARTITION BY {key} ORDER BY i)
        ), smallest AS (
            SELECT {key}, n, i, min(x) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - m} FOLLOWING) AS v FROM windows
        ), steps AS (
            SELECT {key}, i, v, lag(v) OVER (PARTITION BY {key} ORDER BY i) AS before FROM smallest WHERE i <= n - {k} + 1
        ), path AS (
            SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS pos, v FROM steps WHERE before IS NULL OR before <> v
        )"""


def _number(digits: str) -> str:
    return f"list_reduce(list_transform(string_split({digits}, ''), lambda c: CAST(c AS BIGINT)), lambda x, y: x * 4 + y)"


LETTER_SQL = f"translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{seq.LETTERS}', '{seq.LETTER_CODES}')"
BASES_SQL = "translate(upper({}), 'ACTGN', '01233')"
USABLE = "SELECT * FROM minimizer_paths WHERE tx_id IS NOT NULL AND minimizer IS NOT NULL"
STEPS = f"SELECT DISTINCT tx_id, pos, replace(upper(minimizer), 'N', 'G') AS minimizer FROM ({USABLE}) WHERE pos IS NOT NULL"
TRIPLETS = f"""
    SELECT * FROM (
        SELECT tx_id, row_number() OVER w AS pos, minimizer AS a, lead(minimizer, 1) OVER w AS b, lead(minimizer, 2) OVER w AS c
        FROM ({STEPS}) WINDOW w AS (PARTITION BY tx_id ORDER BY pos, minimizer)
    ) WHERE c IS NOT NULL
"""
BARCODES = "SELECT DISTINCT upper(barcode) AS barcode FROM barcode_umi WHERE length(barcode) = 27"
TRIPLE = "SELECT {0}, row_number() OVER w AS pos, v AS a, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS c FROM {1} WINDOW w AS (PARTITION BY {0} ORDER BY pos)"
ITEMS = f"SELECT item_id AS tx_id, item_id % {GENES} AS gene_id, {LETTER_SQL} AS digits FROM eval_items"
ASSIGNED = f"""
    WITH items AS ({ITEMS}),
    item_path AS (WITH {_path_sql('items', 'tx_id', 'digits', K, M)} SELECT * FROM path),
    posted AS (
        SELECT DISTINCT a, b, c, t.tx_id, gene_id FROM ({TRIPLE.format('tx_id', 'item_path')}) AS t JOIN items USING (tx_id) WHERE c IS NOT NULL
    ),
    reads AS (SELECT doc_id AS read_id, {LETTER_SQL} AS digits FROM documents),
    read_path AS (WITH {_path_sql('reads', 'read_id', 'digits', K, M)} SELECT * FROM path),
    read_triplets AS (SELECT * FROM ({TRIPLE.format('read_id', 'read_path')}) WHERE c IS NOT NULL),
    hits AS (SELECT read_id, pos, tx_id, gene_id FROM read_triplets JOIN posted USING (a, b, c)),
    marked AS (
        SELECT read_id, tx_id, gene_id, pos = row_number() OVER w AS unbroken, coalesce(lead(pos) OVER w = pos + 1, false) AS follows
        FROM hits WINDOW w AS (PARTITION BY read_id, tx_id ORDER BY pos)
    ),
    per_tx AS (
        SELECT read_id, tx_id, min(gene_id) AS gene_id, count(*) FILTER (unbroken) AS run, count(*) FILTER (follows) AS score
        FROM marked GROUP BY read_id, tx_id
    ),
    points AS (SELECT DISTINCT read_id, run AS i FROM per_tx WHERE run > 0),
    sets AS (
        SELECT p.read_id, p.i, count(*) AS n, count(DISTINCT gene_id) AS g, min(tx_id) AS tx_id, min(gene_id) AS gene_id
        FROM points AS p JOIN per_tx AS t ON t.read_id = p.read_id AND t.run >= p.i GROUP BY p.read_id, p.i
    ),
    one AS (
        SELECT read_id, min_by(n, i) AS n, min_by(tx_id, i) AS tx_id, min_by(gene_id, i) AS gene_id FROM sets WHERE g = 1 GROUP BY read_id
    ),
    best AS (
        SELECT read_id, count(*) AS n, count(DISTINCT gene_id) AS g, min(tx_id) AS tx_id, min(gene_id) AS gene_id
        FROM (SELECT *, rank() OVER (PARTITION BY read_id ORDER BY score DESC) AS place FROM per_tx) WHERE place = 1 GROUP BY read_id
    ),
    decided AS (
        SELECT r.read_id, CASE
            WHEN r.read_id NOT IN (SELECT read_id FROM read_triplets) THEN 'short'
            WHEN one.n = 1 THEN 'h_tx' WHEN best.n IS NULL THEN 'ambiguous'
            WHEN best.n = 1 THEN CASE WHEN one.n > 1 THEN 'h_tx' ELSE 's_tx' END
            WHEN best.g = 1 THEN CASE WHEN one.n > 1 THEN 'h_gene' ELSE 's_gene' END ELSE 'ambiguous' END AS status,
            CASE WHEN one.n = 1 THEN one.tx_id ELSE best.tx_id END AS t, CASE WHEN one.n = 1 THEN one.gene_id ELSE best.gene_id END AS g
        FROM reads AS r LEFT JOIN one USING (read_id) LEFT JOIN best USING (read_id)
    ),
    assigned AS (
        SELECT read_id, status, CASE WHEN status LIKE '%tx' THEN t END AS tx_id, CASE WHEN status LIKE '%tx' OR status LIKE '%gene' THEN g END AS gene_id FROM decided
    )
"""


def oracle_sql() -> dict[str, str]:
    counters = {
        "reads": "true", "assigned_tx": "status LIKE '%tx'", "assigned_gene": "status LIKE '%gene'", "ambiguous": "status = 'ambiguous'", "short": "status = 'short'",
        "heuristic_tx": "status = 'h_tx'", "heuristic_gene": "status = 'h_gene'", "scored_tx": "status = 's_tx'", "scored_gene": "status = 's_gene'",
    }
    return {
        "seq_encode": f"SELECT DISTINCT minimizer, {BASES_SQL.format('minimizer')} AS digits FROM ({USABLE})",
        "minimizer_numbers": f"SELECT {_number('digits')} AS number, translate(digits, '0123', 'ACTG') AS bases FROM (SELECT DISTINCT {BASES_SQL.format('minimizer')} AS digits FROM ({USABLE}))",
        "reverse_complement": f"SELECT barcode, reverse(translate(barcode, 'ACGTacgt', 'TGCAtgca')) AS reversed FROM ({BARCODES})",
        "barcode_kmers": f"SELECT substr(barcode, i, 20) AS kmer, count(*) AS n FROM ({BARCODES}), unnest(range(1, 9)) AS u(i) GROUP BY 1",
        "barcode_paths": f"WITH given0 AS ({BARCODES}), {_path_sql('given0', 'barcode', BASES_SQL.format('barcode'), 20, 8)} SELECT barcode, CAST(pos AS INTEGER) AS pos, v AS minimizer FROM path",
        "first_read_slices": """
            SELECT CASE WHEN length(r) >= 43 THEN substr(r, 1, 27) ELSE 'UNKNOWN' END AS barcode,
                CASE WHEN length(r) >= 43 THEN substr(r, 28, 16) ELSE 'UNKNOWN' END AS umi, count(*) AS n
            FROM (SELECT barcode || umi AS r FROM barcode_umi) GROUP BY 1, 2
        """,
        "quality_windows": """
            SELECT CAST(CASE WHEN total < 250 THEN 0 WHEN total >= 450 THEN 21 ELSE floor((total - 250) / 10) + 1 END AS BIGINT) AS bin, count(*) AS n
            FROM (
                SELECT list_sum(list_transform(range(i, i + 8), lambda j: ascii(substr(umi, j, 1)) - 33)) AS total
                FROM barcode_umi, unnest(range(1, 10)) AS u(i) WHERE length(umi) = 16
            ) GROUP BY 1
        """,
        "rolling_positions": f"""
            SELECT tx_id, pos, CASE WHEN row_number() OVER (PARTITION BY tx_id ORDER BY pos) >= 5
                THEN CAST(sum(pos) OVER (PARTITION BY tx_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) END AS rolling
            FROM (SELECT DISTINCT tx_id, pos FROM ({USABLE}) WHERE pos IS NOT NULL)
        """,
        "triplet_rows": TRIPLETS,
        "postings_index": f"SELECT DISTINCT t.tx_id, a, b, c, gene_id FROM ({TRIPLETS}) AS t JOIN transcripts ON transcript_id = t.tx_id",
        "posting_stats": f"""
            SELECT a, count(*) AS n_postings, count(DISTINCT (b, c)) AS n_triplets, round(count(*) / count(DISTINCT (b, c)), 6) AS mean_size
            FROM (SELECT DISTINCT a, b, c, tx_id FROM ({TRIPLETS})) GROUP BY a
        """,
        "index_stats": f"""
            SELECT count(*) AS n_triplets, round(avg(n), 6) AS mean_size, CAST(median(n) AS DOUBLE) AS median_size, round(stddev_pop(n), 6) AS sd_size, max(n) AS max_size
            FROM (SELECT count(*) AS n FROM (SELECT DISTINCT a, b, c, tx_id FROM ({TRIPLETS})) GROUP BY a, b, c)
        """,
        "minimizers_per_transcript": f"""
            SELECT tx_id, n_minimizers, n_distinct, tx_len FROM
                (SELECT tx_id, count(*) AS n_minimizers, count(DISTINCT minimizer) AS n_distinct FROM ({USABLE}) GROUP BY tx_id) LEFT JOIN transcripts ON transcript_id = tx_id
        """,
        "path_runs": f"""
            SELECT tx_id, pos, minimizer FROM (SELECT *, lag(minimizer) OVER (PARTITION BY tx_id ORDER BY pos, minimizer) AS before FROM ({STEPS}))
            WHERE before IS NULL OR before <> minimizer
        """,
        "item_tails": f"SELECT tx_id, gene_id, right(digits, {TAIL}) AS digits FROM ({ITEMS})",
        "item_index": f"{ASSIGNED} SELECT tx_id, a, b, c, gene_id FROM posted",
        "assign_documents": f"{ASSIGNED} SELECT * FROM assigned",
        "run_counters": " UNION ALL ".join(f"SELECT '{c}' AS counter, count(*) AS n FROM assigned WHERE {p}" for c, p in counters.items()).join([f"{ASSIGNED} ", ""]),
        "count_levels": f"""{ASSIGNED}
            SELECT 'gene' AS level, CAST(gene_id AS VARCHAR) AS id, CAST(gene_id AS VARCHAR) AS gene_id, count(*) AS n FROM assigned WHERE gene_id IS NOT NULL GROUP BY 2, 3
            UNION ALL SELECT 'transcript', CAST(tx_id AS VARCHAR), CAST(gene_id AS VARCHAR), count(*) FROM assigned WHERE tx_id IS NOT NULL GROUP BY 2, 3
        """,
    }
