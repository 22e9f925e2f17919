"""Column expressions on nucleotide and letter sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-bit codes of the letters a to z, in order, and of the four nucleotides (N counts as G).
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTER_CODES = "01122330011223300112233001"
NUCLEOTIDES = "ACTG"
NUCLEOTIDE_CODES = "0123"


def encode_bases(sequence: Column) -> Column:
    """Base-4 digits of a nucleotide sequence; case does not matter, N has the digit of G."""
    return F.translate(F.upper(sequence), NUCLEOTIDES + "N", NUCLEOTIDE_CODES + "3")


def encode_letters(text: Column) -> Column:
    """Base-4 digits of the letters a to z of any text, other characters left out."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, LETTER_CODES)


def decode_digits(digits: Column) -> Column:
    """The nucleotides of base-4 digits."""
    return F.translate(digits, NUCLEOTIDE_CODES, NUCLEOTIDES)


def digits_to_number(digits: Column) -> Column:
    """The number that base-4 digits stand for (at most 31 of them)."""
    return F.conv(digits, 4, 10).cast("bigint")


def number_to_bases(number: Column, length: int) -> Column:
    """The nucleotides of a minimizer given as a number."""
    return decode_digits(F.lpad(F.conv(number.cast("string"), 10, 4), length, "0"))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGTacgt", "TGCAtgca"))


def tail(sequence: Column, length: Column | int) -> Column:
    """The last ``length`` bases, or all if there are fewer; null is an empty sequence."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.right(F.coalesce(sequence, F.lit("")), F.greatest(n, F.lit(0)))


def utr_tail(sequence: Column, utr_length: Column, plus: int = 500) -> Column:
    """The 3' UTR and ``plus`` bases before it."""
    return tail(sequence, F.coalesce(utr_length, F.lit(0)) + plus)


def barcode_of(read: Column) -> Column:
    """Bases 1-27 of a first read; ``UNKNOWN`` if it has fewer than 43 bases or is missing."""
    return F.when(F.length(read) >= 43, F.substring(read, 1, 27)).otherwise("UNKNOWN")


def umi_of(read: Column) -> Column:
    """Bases 28-43 of a first read; ``UNKNOWN`` if it has fewer than 43 bases or is missing."""
    return F.when(F.length(read) >= 43, F.substring(read, 28, 16)).otherwise("UNKNOWN")


def kmers(sequence: Column, k: int) -> Column:
    """Array of the k-mers of a sequence, empty if it is shorter than k."""
    starts = F.sequence(F.lit(1), F.length(sequence) - (k - 1))
    return F.when(F.length(sequence) >= k, F.transform(starts, lambda i: F.substring(sequence, i, F.lit(k)))).otherwise(
        F.array().cast("array<string>")
    )


def phred_scores(quality: Column) -> Column:
    """Array of the phred scores of a quality string (offset 33)."""
    return F.transform(F.split(quality, ""), lambda c: F.ascii(c) - 33)


def window_sums(values: Column, k: int) -> Column:
    """Array of the sums of k successive values, empty if there are fewer."""
    starts = F.sequence(F.lit(1), F.size(values) - (k - 1))
    add = lambda i: F.aggregate(F.slice(values, i, k), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return F.when(F.size(values) >= k, F.transform(starts, add)).otherwise(F.array().cast("array<bigint>"))


def kmer_flag(kmer: Column, quality_sum: Column, k: int, least_mean: int = 19) -> Column:
    """``unclear`` if the k-mer has an N, ``poor`` if its mean quality is below ``least_mean``, else ``good``."""
    return F.when(F.upper(kmer).contains("N"), "unclear").when(quality_sum < least_mean * k, "poor").otherwise("good")


def gc_share(sequence: Column) -> Column:
    """Share of G and C in a sequence; null if it is empty."""
    n = F.length(sequence)
    return F.when(n > 0, F.length(F.regexp_replace(F.upper(sequence), "[^GC]", "")) / n)
