"""Reads of several files."""

from tallyloom.pipeline import count_reads
from tallyloom.sources import readers
from tests.helpers import rows
from tests.test_pipeline import files, index, text  # noqa: F401


def split(source, folder, cut, end):
    lines = source.read_text().splitlines(keepends=True)
    folder.mkdir()
    for name, part in (("a.fq", lines[:cut]), ("b.fq", []), ("c d.fq", lines[cut:end])):
        (folder / name).write_text("".join(part))


def test_reads_of_several_files(spark, files, index, tmp_path):  # noqa: F811
    split(files / "r2.fq", tmp_path / "second", 8, None)
    count_reads(spark, index, str(tmp_path / "second"), str(tmp_path / "bulk"), details=True)
    assert text(tmp_path / "bulk/read_assignments.tsv") == ["T1", "T2", "T3", "T1", "*", "*"]
    assert text(tmp_path / "bulk/counts.tsv") == ["GA\t3", "T1\t2", "T2\t1", "GB\t1", "T3\t1"]
    (summary,) = readers.read_summaries(spark, str(tmp_path / "bulk/summary")).collect()
    assert (summary.reads, summary.assigned_tx, summary.short) == (6, 4, 2)


def test_pairs_of_several_files(spark, tmp_path):
    """The first files hold a read more in the first of them, and reads in one whose partner is empty."""
    for side, given in (("second", {"a": "AC", "b": "", "c": "GT"}), ("first", {"a": "ACT", "b": "T", "c": "GT"})):
        (tmp_path / side).mkdir()
        for name, letters in given.items():
            (tmp_path / side / f"{name}.fq").write_text("".join(f"@{name}{i}\n{base * 43}\n+\n{'I' * 43}\n" for i, base in enumerate(letters)))
    both, unused = readers.paired(*(readers.read_fastq(spark, str(tmp_path / side)) for side in ("second", "first")))
    assert unused == 2
    assert [(name, seq[0], barcode[0]) for name, seq, barcode in rows(both, "name", "seq", "barcode")] == [("a0", "A", "A"), ("a1", "C", "C"), ("c0", "G", "G"), ("c1", "T", "T")]
