"""Minimizer paths, triplets and the inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import spread


def check_lengths(k: int, m: int) -> None:
    """Raise unless 0 < m < k <= 31: a minimizer is shorter than its k-mer, and a k-mer fits 62 bits."""
    if not 0 < m < k <= 31:
        raise ValueError(f"k-mers of {k} and minimizers of {m} bases: 0 < m < k <= 31 is needed")


def _path(digits: str, k: int, m: int) -> np.ndarray:
    """Smallest m-window of each k-mer of base-4 digits, successive repetitions left out."""
    if len(digits) < k:
        return np.empty(0, np.int64)
    codes = np.frombuffer(digits.encode(), np.uint8).astype(np.int64) - ord("0")
    windows = np.zeros(len(codes) - m + 1, np.int64)
    for offset in range(m):
        windows = windows * 4 + codes[offset : offset + len(windows)]
    smallest = np.lib.stride_tricks.sliding_window_view(windows, k - m + 1).min(axis=1)
    return smallest[np.r_[True, smallest[1:] != smallest[:-1]]]


def minimizer_paths(df: DataFrame, key: str, digits: str, k: int, m: int) -> DataFrame:
    """``<key>, path``: the ordered minimizers (as numbers) of each sequence of base-4 digits.

    One row for each given row; a null sequence or one shorter than ``k`` has an empty path. The work is local to a
    row, so nothing is shuffled.
    """
    check_lengths(k, m)
    given = spread(df.select(F.col(key).alias("key"), F.col(digits).alias("digits")))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_path(d or "", k, m) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], [key, "path"])

    return given.mapInArrow(paths, f"`{key}` {dict(given.dtypes)['key']}, path array<bigint>")


def path_triplets(paths: DataFrame, key: str) -> DataFrame:
    """``<key>, pos, a, b, c``: each three successive minimizers of a path, positions from 1."""
    shifted = F.arrays_zip(
        F.col("path").alias("a"), F.slice("path", 2, F.greatest(F.size("path"), F.lit(1))).alias("b"),
        F.slice("path", 3, F.greatest(F.size("path"), F.lit(1))).alias("c"),
    )
    rows = paths.where(F.size("path") >= 3).select(key, F.posexplode(shifted).alias("at", "t"))
    return rows.where("t.c is not null").select(key, (F.col("at") + 1).alias("pos"), "t.a", "t.b", "t.c")


def row_triplets(rows: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """As ``path_triplets``, of a path given as one row for each position; repeated rows count once."""
    order = Window.partitionBy(key).orderBy(position, value)
    steps = rows.select(key, position, value).where(f"`{key}` is not null and `{value}` is not null").distinct().select(
        key, F.row_number().over(order).alias("pos"), F.col(value).alias("a"),
        F.lead(value, 1).over(order).alias("b"), F.lead(value, 2).over(order).alias("c"),
    )
    return steps.where("c is not null")


def postings(triplets: DataFrame, key: str) -> DataFrame:
    """The inverted index: each triplet with every transcript that has it, ``a, b, c, <key>``. Its key is the triplet itself, so none collide."""
    return triplets.select("a", "b", "c", key).distinct()


def posting_stats(index: DataFrame) -> DataFrame:
    """One row: number of triplets, and mean, median, population deviation and maximum of their posting sizes."""
    sizes = index.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_triplets"), F.round(F.avg("n"), 6).alias("mean_size"), F.percentile("n", F.lit(0.5)).alias("median_size"),
        F.round(F.stddev_pop("n"), 6).alias("sd_size"), F.max("n").alias("max_size"),
    )
