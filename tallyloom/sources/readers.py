"""Readers of annotation, sequence and result files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.session import Written

GTF_COLUMNS = "contig STRING, source STRING, feature STRING, start INT, end INT, score STRING, strand STRING, frame STRING, attrs STRING"


def attribute(name: str):
    """A quoted attribute of a GTF row; null where it is absent."""
    return F.nullif(F.regexp_extract("attrs", rf'(?:^|;|\s){name}\s+"([^"]*)"', 1), F.lit(""))


def read_gtf(spark: SparkSession, path: str, features: tuple[str, ...] = ("transcript", "exon", "three_prime_utr")) -> DataFrame:
    """Annotation rows of the given features with ``transcript_id``, ``gene_id``, ``is_negative`` and their order (``row``); plain or gzip.

    Comments and rows without a transcript id are left out. Gzip files cannot be split; many files are read side by side.
    """
    rows = spark.read.csv(path, schema=GTF_COLUMNS, sep="\t", comment="#", quote="").withColumn("row", F.monotonically_increasing_id())
    wanted = rows.where(F.col("feature").isin(*features))
    return wanted.select(
        "contig", "feature", "start", "end", (F.col("strand") == "-").alias("is_negative"),
        attribute("transcript_id").alias("transcript_id"), attribute("gene_id").alias("gene_id"),
        attribute("gene_biotype").alias("gene_biotype"), attribute("exon_number").try_cast("int").alias("exon_number"), "row",
    ).where("transcript_id is not null")


def transcripts_of(rows: DataFrame) -> DataFrame:
    """One row for each transcript of ``read_gtf``, its exons sorted by start.

    Exons without a transcript row give none (their position is not known). The last gene id that a row names, and the last
    transcript row, hold; repeated exons count once.
    """
    exon = F.when(F.col("feature") == "exon", F.struct(F.col("start").alias("exon_start"), F.col("end").alias("exon_end")))
    utr = F.coalesce(F.sum(F.when(F.col("feature") == "three_prime_utr", F.col("end") - F.col("start") + 1)), F.lit(0)).cast("int")
    last = lambda c: F.max_by(c, F.when(F.col("feature") == "transcript", F.col("row"))).alias(c)
    width = F.aggregate("exons", F.lit(0), lambda s, e: s + e["exon_end"] - e["exon_start"] + 1)
    grouped = rows.groupBy("transcript_id").agg(
        F.max_by("gene_id", F.when(F.col("gene_id").isNotNull(), F.col("row"))).alias("gene_id"), last("contig"), last("start"), last("end"), last("is_negative"),
        F.array_sort(F.collect_set(exon)).alias("exons"), utr.alias("utr_len"),
    ).where("start is not null and size(exons) > 0")
    return grouped.select(
        "transcript_id", "gene_id", F.col("contig").alias("chrom"), F.col("start").alias("tx_start"), F.col("end").alias("tx_end"), "is_negative", "exons",
        width.alias("tx_len"), "utr_len",
    )


#: Lines of a file are placed in slices of so many.
LINES_A_SLICE = 65_536


def read_fasta(spark: SparkSession, path: str, *, slice_lines: int = LINES_A_SLICE) -> DataFrame:
    """``contig, chunk_no, chunk_start, bases``: a genome in the chunks of its lines, 1-based.

    Contigs may be of any length: a line's place in its contig is found within slices of ``slice_lines`` lines, and the header,
    bases and chunks before a slice are carried over one row per slice. Lines before a file's first header are left out.
    """
    is_head = F.col("value").startswith(">")
    lines = _numbered_lines(spark, path).select(
        "file", "line", F.floor(F.col("line") / slice_lines).alias("slice"), F.when(is_head, F.regexp_extract("value", r"^>\s*(\S+)", 1)).alias("name"),
        F.when(~is_head, F.trim("value")).alias("bases"),
    ).where("name is not null or bases <> ''")
    within = Window.partitionBy("file", "slice").orderBy("line")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("n_bases", F.coalesce(F.sum(F.length("bases")).over(before), F.lit(0))).withColumn("n_chunks", F.count("bases").over(before))
    head = F.max(F.when(F.col("name").isNotNull(), F.struct("line", "n_bases", "n_chunks", "name")))

    earlier = Window.partitionBy("file").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before")
    of_file = lambda h: F.struct(h["line"].alias("line"), (h["n_bases"] + F.col("bases_before")).alias("n_bases"), (h["n_chunks"] + F.col("chunks_before")).alias("n_chunks"), h["name"].alias("name"))
    found = lambda h: F.when(F.col(h).isNotNull(), of_file(F.col(h)))
    slices = placed.groupBy("file", "slice").agg(F.coalesce(F.sum(F.length("bases")), F.lit(0)).alias("bases"), F.count("bases").alias("chunks"), head.alias("last_head"))
    carried = slices.select("file", "slice", so_far("bases"), so_far("chunks"), "last_head").withColumn("carried_head", F.max(found("last_head")).over(earlier)).drop("last_head")

    own = placed.withColumn("own_head", head.over(within.rowsBetween(Window.unboundedPreceding, 0))).where("bases is not null")
    headed = own.join(carried, ["file", "slice"]).withColumn("head", F.coalesce(found("own_head"), F.col("carried_head"))).where("head is not null")
    return headed.select(
        F.col("head.name").alias("contig"), (F.col("chunks_before") + F.col("n_chunks") - F.col("head.n_chunks")).alias("chunk_no"),
        (F.col("bases_before") + F.col("n_bases") - F.col("head.n_bases") + 1).alias("chunk_start"), "bases",
    )


def regular_chunks(genome: DataFrame, chunk_width: int) -> DataFrame:
    """Chunks of exactly ``chunk_width`` bases (the last of a contig may be shorter), numbered from 0, as ``spliced`` needs them."""
    rows = genome.withColumn("at", F.col("chunk_start") - 1).withColumn("last", F.floor((F.col("at") + F.length("bases") - 1) / chunk_width))
    cut = rows.withColumn("no", F.explode(F.sequence(F.floor(F.col("at") / chunk_width), F.col("last"))))
    begin = F.greatest(F.col("at"), F.col("no") * chunk_width)
    end = F.least(F.col("at") + F.length("bases"), (F.col("no") + 1) * chunk_width)
    piece = F.struct(begin.alias("begin"), F.substring("bases", begin - F.col("at") + 1, end - begin).alias("bases"))
    grouped = cut.select("contig", "no", piece.alias("piece")).groupBy("contig", "no").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return grouped.select(
        "contig", F.col("no").alias("chunk_no"), (F.col("no") * chunk_width + 1).alias("chunk_start"),
        F.array_join(F.transform("pieces", lambda p: p["bases"]), "").alias("bases"),
    )


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value``: lines of text files with their number from 0.

    Lines are counted for each split of a file; the number of a line is its place in its split after the lines of the
    splits before it. The counts alone (one row for each split) are summed up per file.
    """
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("row")
    )
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("row") - F.col("first")).alias("line"), "value")


#: Fixed value: read numbers of a file start at its number times this, which no file of reads reaches.
READS_A_FILE = 2**40


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``read_id, name, seq, qual``: each four lines of FASTQ files (plain or gzip).

    Reads are numbered from 0 within a file, on top of ``READS_A_FILE`` times the number of the file; files are numbered
    from 0 by path, empty ones as well, so that first and second reads pair up file by file.
    """
    names = sorted(spark.read.text(path).inputFiles())  # scans leave out empty files, this list does not
    numbered = spark.createDataFrame([(name, no) for no, name in enumerate(names)], "file string, file_no bigint")  # one row for each file
    alike = lambda df: df.withColumn("file", F.regexp_replace("file", "^([^:/]+:)/+", "$1/"))  # noqa: E731  file:///a in one is file:/a in the other
    number = F.coalesce("file_no", F.raise_error(F.concat(F.lit("not in the list of files: "), "file")).cast("bigint"))
    place = number * READS_A_FILE + F.floor(F.col("line") / 4)
    lines = alike(_numbered_lines(spark, path)).join(F.broadcast(alike(numbered)), "file", "left").withColumn("read_id", place)
    at = lambda i: F.max(F.when(F.col("line") % 4 == i, F.col("value")))
    whole = lines.groupBy("read_id").agg(at(0).alias("name"), at(1).alias("seq"), at(3).alias("qual"))
    return whole.select("read_id", F.regexp_extract("name", r"^@?(\S*)", 1).alias("name"), "seq", "qual").where("seq is not null")


def paired(second: DataFrame, first: DataFrame) -> tuple[DataFrame, int]:
    """Second reads with barcode and UMI of the first read at the same place of the same file, and the number of first reads left over.

    Both sides are joined once, and written. A second read without a first one raises: the files do not belong together.
    """
    from tallyloom.functions.sequence import barcode_of, umi_of

    bars = first.select(F.col("read_id").alias("of"), barcode_of(F.col("seq")).alias("barcode"), umi_of(F.col("seq")).alias("umi"))
    met = second.join(bars, F.col("read_id") == F.col("of"), "full")
    both = Written(met, unpaired=F.count_if(F.col("of").isNull()), unused=F.count_if(F.col("read_id").isNull()))
    if both.values["unpaired"]:
        raise ValueError("there are fewer first reads than second reads")
    return both.df.where("read_id is not null").drop("of"), both.values["unused"]


def read_table_file(spark: SparkSession, path: str, schema: str, *, sep: str = "\t", header: bool = False, skip: int = 0) -> DataFrame:
    """A delimited text file with an explicit schema; ``skip`` leaves out so many lines at the start of each file."""
    if not skip:
        return spark.read.csv(path, schema=schema, sep=sep, header=header)
    lines = _numbered_lines(spark, path).where(F.col("line") >= skip + int(header))
    parsed = F.from_csv("value", F.lit(schema), {"sep": sep})
    return lines.select(parsed.alias("r")).select("r.*")


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    """``contig, start, end, repeat_name, repeat_class`` of a repeat annotation with three header lines; 0-based half-open."""
    part = F.split(F.trim("value"), r"\s+")
    lines = _numbered_lines(spark, path).where("line >= 3").select(part.alias("p")).where(F.size("p") >= 11)
    return lines.select(
        F.col("p")[4].alias("contig"), (F.col("p")[5].cast("int") - 1).alias("start"), F.col("p")[6].cast("int").alias("end"),
        F.col("p")[9].alias("repeat_name"), F.col("p")[10].alias("repeat_class"),
    )


def read_paralogs(spark: SparkSession, path: str) -> DataFrame:
    """``gene, paralog``: one row for each entry of the comma lists; rows of fewer than two fields are left out."""
    rows = spark.read.csv(path, schema="gene STRING, paralogs STRING", sep="\t").where("gene is not null and paralogs is not null")
    return rows.select("gene", F.explode(F.split("paralogs", ",")).alias("paralog")).where("trim(paralog) <> ''")


def read_homologies(spark: SparkSession, paths: list[str], *, taxon: str, own: str = "stable_id") -> DataFrame:
    """Paralog links of many homology files: columns 2 (type), 4 (stable id) and 5 (taxon), the gene taken from the file's name.

    Missing files are passed over.
    """
    rows = spark.read.option("ignoreMissingFiles", True).csv(paths, sep="\t", schema="c1 STRING, type STRING, c3 STRING, stable_id STRING, taxon STRING")
    gene = F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1)
    linked = rows.select(gene.alias("gene"), "type", F.col(own).alias("paralog"), "taxon")
    return linked.where(F.col("type").rlike("paralog") & (F.col("taxon") == taxon) & (F.col("gene") != F.col("paralog"))).select("gene", "paralog").distinct()


def read_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """``feature, barcode, n`` of a sparse matrix in its three text files."""
    entries = _numbered_lines(spark, f"{folder}/matrix.mtx").where("value not like '\\%%'")
    first = entries.groupBy("file").agg(F.min("line").alias("line"))
    cells = entries.join(first, ["file", "line"], "left_anti").select(F.split(F.trim("value"), r"\s+").alias("p"))
    named = lambda file, name: _numbered_lines(spark, f"{folder}/{file}").select((F.col("line") + 1).alias(f"{name}_idx"), F.split("value", "\t")[0].alias(name))
    indexed = cells.select(F.col("p")[0].cast("bigint").alias("feature_idx"), F.col("p")[1].cast("bigint").alias("barcode_idx"), F.col("p")[2].cast("bigint").alias("n"))
    return indexed.join(named("features.tsv", "feature"), "feature_idx").join(named("barcodes.tsv", "barcode"), "barcode_idx").select("feature", "barcode", "n")


#: The counters of a run summary and the labels they have in its text, in the order of the file.
SUMMARY = {
    "reads": "Total reads processed", "assigned_tx": "Reads assigned to transcripts", "assigned_gene": "Reads assigned to genes",
    "ambiguous": "Ambiguous reads", "short": "Short reads discarded", "heuristic_tx": "Heuristic phase - transcripts",
    "heuristic_gene": "Heuristic phase - genes", "scored_tx": "Scoring phase - transcripts", "scored_gene": "Scoring phase - genes",
}


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """``run`` (the file's folder) and the counters of run summaries, read as whole files of ``label: number`` lines; other lines are passed over."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("run"), "value")
    return text.select("run", *[F.regexp_extract("value", rf"(?m)^{label}\s*:\s*([0-9]+)", 1).try_cast("bigint").alias(c) for c, label in SUMMARY.items()])


def read_metrics(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """One row for each log file with the last number that follows each name; null where a name does not occur."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    of = lambda n: F.regexp_extract("value", rf"\b{n}\b\D*?(-?[0-9]+(?:\.[0-9]+)?)", 1)
    return lines.groupBy("file").agg(*[F.max_by(of(n).try_cast("double"), F.when(of(n) != "", F.col("at"))).alias(n) for n in names])


def list_files(spark: SparkSession, path: str, pattern: str = r"k([0-9]+).*?m([0-9]+)") -> DataFrame:
    """``path, k, m, size`` of the files of a folder, the parameters taken from their names. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", F.regexp_extract(name, pattern, 1).try_cast("int").alias("k"), F.regexp_extract(name, pattern, 2).try_cast("int").alias("m"), F.col("length").alias("size"))
