import gzip
import random

import pytest

from tallyloom.operators.annotation import bed_rows, exon_rows, last_bases
from tallyloom.pipeline import build_index, count_reads
from tallyloom.sources import readers, writers
from tests.helpers import rows

RNG = random.Random(11)
GENOME = {c: "".join(RNG.choice("ACGT") for _ in range(3000)) for c in ("c1", "c2")}
COMPLEMENT = str.maketrans("ACGT", "TGCA")
# gene, strand, contig, exons, utr
ANNOTATION = {
    "T1": ("GA", "+", "c1", [(101, 300), (401, 600)], None), "T2": ("GA", "+", "c1", [(151, 250), (701, 900)], (801, 900)), "T3": ("GB", "-", "c2", [(1001, 1200), (1301, 1400), (1501, 1700)], None),
    "T4": ("GC", "+", "c2", [(10, 20)], None), "T5": (None, "+", "c2", [(2000, 2400)], None), "T6": ("GD", "+", "missing", [(1, 100)], None),
}


def sequence_of(tx):
    gene, strand, contig, exons, _ = ANNOTATION[tx]
    bases = "".join(GENOME[contig][s - 1 : e] for s, e in exons)
    return bases[::-1].translate(COMPLEMENT) if strand == "-" else bases


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    with open(folder / "genome.fa", "w") as out:
        for name, bases in GENOME.items():
            out.write(f">{name} description\n" + "".join(bases[i : i + 70] + "\n" for i in range(0, len(bases), 70)))
    lines = ["#!comment"]
    for tx, (gene, strand, contig, exons, utr) in ANNOTATION.items():
        attrs = (f'gene_id "{gene}"; ' if gene else "") + f'transcript_id "{tx}"; gene_biotype "coding";'
        spans = [("transcript", exons[0][0], exons[-1][1])] + [("exon", *e) for e in reversed(exons)] + ([("three_prime_utr", *utr)] if utr else [])
        lines += [f"{contig}\tsrc\t{kind}\t{s}\t{e}\t.\t{strand}\t.\t{attrs}" for kind, s, e in spans]
    lines += ['c1\tsrc\texon\t1\t50\t.\t+\t.\tgene_id "GE"; transcript_id "T7";', 'c1\tsrc\tgene\t1\t50\t.\t+\t.\tgene_id "GE";']
    with gzip.open(folder / "genes.gtf.gz", "wt") as out:
        out.write("\n".join(lines) + "\n")
    reads = [(tx, sequence_of(tx)[-90:-15]) for tx in ("T1", "T2", "T3", "T1")] + [("poly", "A" * 75), ("tiny", "ACG")]
    with open(folder / "r2.fq", "w") as second, open(folder / "r1.fq", "w") as first:
        for i, (tx, bases) in enumerate(reads):
            second.write(f"@r{i} {tx}\n{bases}\n+\n{'I' * len(bases)}\n")
            first.write(f"@r{i}\n{('ACGT' * 20)[: 27]}{'ACGTACGTACGTACGT' if tx == 'T1' else 'C' * 16}\n+\n{'I' * 43}\n")
        first.write("@extra\nACGT\n+\nIIII\n")
    return folder


@pytest.fixture(scope="module")
def index(spark, files):
    left_out = build_index(spark, str(files / "genes.gtf.gz"), str(files / "genome.fa"), str(files / "index"), k=20, m=8)
    assert rows(left_out, "transcript_id") == [("T4",), ("T5",), ("T6",)]
    return str(files / "index")


def text(folder):
    return [line for f in sorted(folder.glob("part-*")) for line in f.read_text().splitlines()]


def test_genome_and_annotation(spark, files):
    genome = readers.regular_chunks(readers.read_fasta(spark, str(files / "genome.fa")), 100)
    whole = {c: "".join(r.bases for r in genome.where(f"contig = '{c}'").orderBy("chunk_no").collect()) for c in GENOME}
    assert whole == GENOME
    transcripts = readers.transcripts_of(readers.read_gtf(spark, str(files / "genes.gtf.gz")))
    got = {r.transcript_id: (r.gene_id, r.is_negative, [tuple(e) for e in r.exons], r.tx_len, r.utr_len) for r in transcripts.collect()}
    assert got["T2"] == ("GA", False, [(151, 250), (701, 900)], 300, 100) and got["T3"][1] and got["T5"][0] is None and "T7" not in got
    from tallyloom.operators.annotation import spliced

    assert dict(rows(spliced(exon_rows(transcripts), genome, chunk_width=100))) == {t: sequence_of(t) for t in ("T1", "T2", "T3", "T4", "T5")}


def test_contigs_go_over_slices(spark, tmp_path):
    (tmp_path / "a.fa").write_text("AAAA\n>c1 first\nACGT\nAC\n\nGGG\n>c2\n>c3\nT\nTT\n" + "".join(f"{'ACGT'[i % 4]}\n" for i in range(30)))
    (tmp_path / "b.fa").write_text(">d\nCC\n>e\n")
    want = [("c1", 0, 1, "ACGT"), ("c1", 1, 5, "AC"), ("c1", 2, 7, "GGG"), ("c3", 0, 1, "T"), ("c3", 1, 2, "TT"), ("d", 0, 1, "CC")]
    want += [("c3", 2 + i, 4 + i, "ACGT"[i % 4]) for i in range(30)]
    for n in (1, 2, 3, 7, 1000):
        assert rows(readers.read_fasta(spark, str(tmp_path), slice_lines=n)) == sorted(want)


def test_last_bases_and_bed(spark, files):
    transcripts = readers.transcripts_of(readers.read_gtf(spark, str(files / "genes.gtf.gz")))
    assert rows(last_bases(transcripts.where("transcript_id = 'T3'"), 250), "exon_start", "exon_end") == [(1001, 1200), (1301, 1350)]
    assert rows(last_bases(transcripts.where("transcript_id = 'T2'"), 150), "exon_start", "exon_end") == [(201, 250), (701, 900)]
    assert last_bases(transcripts, 0).count() == 0
    writers.write_bed(bed_rows(last_bases(transcripts.where("transcript_id = 'T3'"), 250)), str(files / "bed"))
    assert text(files / "bed") == ["c2\t1000\t1200\tT3\t0\t-", "c2\t1300\t1350\tT3\t0\t-"]


def test_bulk_counts(spark, files, index):
    count_reads(spark, index, str(files / "r2.fq"), str(files / "bulk"), details=True)
    assert text(files / "bulk/read_assignments.tsv") == ["T1", "T2", "T3", "T1", "*", "*"]
    assert text(files / "bulk/counts.tsv") == ["GA\t3", "T1\t2", "T2\t1", "GB\t1", "T3\t1"]
    (summary,) = readers.read_summaries(spark, str(files / "bulk/summary")).collect()
    assert (summary.reads, summary.assigned_tx, summary.short) == (6, 4, 2)


def test_counts_by_barcode(spark, files, index, capsys):
    count_reads(spark, index, str(files / "r2.fq"), str(files / "cells"), first=str(files / "r1.fq"))
    assert "1 first reads" in capsys.readouterr().out
    assert text(files / "cells/features.tsv") == ["GA\tGA\tgene", "GB\tGB\tgene", "T1\tT1\ttranscript", "T2\tT2\ttranscript", "T3\tT3\ttranscript"]
    assert text(files / "cells/matrix.mtx") == ["%%MatrixMarket matrix coordinate integer general", "5 1 5", "1 1 2", "2 1 1", "3 1 1", "4 1 1", "5 1 1"]


def test_matrix_is_read_back(spark, files, index):
    folder = files / "cells"
    plain = files / "plain"
    plain.mkdir()
    for name in ("matrix.mtx", "features.tsv", "barcodes.tsv"):
        (plain / name).write_text("\n".join(text(folder / name)) + "\n")
    got = rows(readers.read_matrix(spark, str(plain)), "feature", "n")
    assert got == [("GA", 2), ("GB", 1), ("T1", 1), ("T2", 1), ("T3", 1)]


def test_pairs_must_match(spark, files):
    short = readers.read_fastq(spark, str(files / "r1.fq")).where("read_id < 2")
    with pytest.raises(ValueError):
        readers.paired(readers.read_fastq(spark, str(files / "r2.fq")), short)


def test_other_readers(spark, tmp_path):
    (tmp_path / "rep.out").write_text("a\nb\n\n 1 2 3 4 c1 11 20 (9) + AluY SINE/Alu 1 2\n")
    assert rows(readers.read_repeats(spark, str(tmp_path / "rep.out"))) == [("c1", 10, 20, "AluY", "SINE/Alu")]
    (tmp_path / "par.tsv").write_text("g1\tg2,g3\ng4\n")
    assert rows(readers.read_paralogs(spark, str(tmp_path / "par.tsv"))) == [("g1", "g2"), ("g1", "g3")]
    (tmp_path / "t.tsv").write_text("# skipped\nid\tn\na\t1\n")
    assert rows(readers.read_table_file(spark, str(tmp_path / "t.tsv"), "id STRING, n INT", skip=1, header=True)) == [("a", 1)]
    (tmp_path / "run.log").write_text("visited: 3\nvisited: 7\nrate 0.5\n")
    assert rows(readers.read_metrics(spark, str(tmp_path / "run.log"), ["visited", "rate", "none"]), "visited", "rate", "none") == [(7.0, 0.5, None)]
    (tmp_path / "idx").mkdir()
    (tmp_path / "idx" / "k19_m08.bin").write_bytes(b"12345")
    assert rows(readers.list_files(spark, str(tmp_path / "idx")), "k", "m", "size") == [(19, 8, 5)]
    (tmp_path / "ENSG1.tsv").write_text("x\twithin_species_paralog\tx\tg2\t9823\nx\tortholog\tx\tg3\t9823\n")
    assert rows(readers.read_homologies(spark, [str(tmp_path / "ENSG1.tsv")], taxon="9823")) == [("ENSG1", "g2")]
