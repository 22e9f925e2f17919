"""Simulated counts: a reproducible sample of transcripts with gamma-distributed numbers of reads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled(df: DataFrame, key: str, n: int, *, seed: int = 42) -> DataFrame:
    """``n`` rows, those whose key and seed hash smallest; the same rows at any partitioning (a top-k, not a full sort)."""
    return df.where(f"`{key}` is not null").orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def first_reads(reads: DataFrame, n: int, *, read: str = "read_id") -> DataFrame:
    """The first ``n`` reads of an input, by their number: a top-k by which runs of growing size are made. Null numbers are left out."""
    return reads.where(f"`{read}` is not null").orderBy(read).limit(n)


def simulated_counts(df: DataFrame, key: str, *, low: int, high: int, shape: float = 1.3, share: float = 0.07, seed: int = 42) -> DataFrame:
    """``<key>, count``: gamma-distributed counts from ``low`` on, with a scale of ``share`` of the range, at most ``high``.

    Each row draws from its own stream, seeded by its key, so the result does not depend on partitions or retries.
    Halves are rounded to even. Null keys give no rows.
    """
    if high < low:
        raise ValueError("high is below low")

    @F.pandas_udf("bigint")
    def draw(seeds: pd.Series) -> pd.Series:
        values = [np.random.Generator(np.random.Philox(key=s & 0xFFFFFFFFFFFFFFFF)).gamma(shape, share * (high - low)) for s in seeds]
        return pd.Series(np.minimum(np.rint(np.array(values) + low), high).astype("int64"))

    return df.where(f"`{key}` is not null").select(key, draw(F.xxhash64(F.col(key), F.lit(seed))).alias("count"))
