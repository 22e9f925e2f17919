"""Evaluation of runs: correlation, precision and recall, and the frames behind reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import written


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, null where the whole is 0."""
    return F.when(whole != 0, part / whole)


def correlation(pairs: DataFrame, x: str, y: str, *, by: list[str] | None = None) -> DataFrame:
    """``r, n, total_x, total_y, highest`` of log2(x + 1) and log2(y + 1), for each group of ``by``.

    Nulls count as 0. The logarithm of a negative count is null, and such a pair is left out of ``r``.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    valued = pairs.select(*(by or []), zero(x).alias("x"), zero(y).alias("y"))
    return valued.groupBy(*(by or [])).agg(
        F.round(F.corr(F.log2(F.col("x") + 1), F.log2(F.col("y") + 1)), 6).alias("r"), F.count(F.lit(1)).alias("n"),
        F.round(F.sum("x"), 3).alias("total_x"), F.round(F.sum("y"), 3).alias("total_y"), F.round(F.max(F.greatest("x", "y")), 3).alias("highest"),
    )


def precision_recall(rows: DataFrame, truth: str, estimate: str, *, by: list[str] | None = None) -> DataFrame:
    """``correct, wrong, unassigned, precision, recall, f1``. A null estimate is unassigned; rows without truth are left out."""
    known = rows.where(F.col(truth).isNotNull())
    counted = known.groupBy(*(by or [])).agg(
        F.count_if(F.col(truth) == F.col(estimate)).alias("correct"), F.count_if(F.col(truth) != F.col(estimate)).alias("wrong"),
        F.count_if(F.col(estimate).isNull()).alias("unassigned"),
    )
    p = share(F.col("correct"), F.col("correct") + F.col("wrong"))
    r = share(F.col("correct"), F.col("correct") + F.col("wrong") + F.col("unassigned"))
    return counted.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(share(2 * p * r, p + r), 6).alias("f1"))


def mean_of_recalls(rows: DataFrame, truth: str, estimate: str, *, by: list[str]) -> DataFrame:
    """``<by>, n_groups, mean_recall``: recall of each truth value, then their mean."""
    per_value = rows.where(F.col(truth).isNotNull()).groupBy(*by, truth).agg(
        F.avg(F.coalesce((F.col(truth) == F.col(estimate)).cast("double"), F.lit(0.0))).alias("recall")
    )
    return per_value.groupBy(*by).agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg("recall"), 6).alias("mean_recall"))


def shared_and_unique(a: DataFrame, b: DataFrame, group: list[str], member: str) -> DataFrame:
    """``<group>, shared, only_a, only_b``: distinct members on both sides and on one side only."""
    left = a.select(*group, member).distinct().withColumn("__a", F.lit(True))
    right = b.select(*group, member).distinct().withColumn("__b", F.lit(True))
    both = left.join(right, [*group, member], "full")
    return both.groupBy(*group).agg(
        F.count_if(F.col("__a") & F.col("__b")).alias("shared"), F.count_if(F.col("__b").isNull()).alias("only_a"),
        F.count_if(F.col("__a").isNull()).alias("only_b"),
    )


def status_shares(rows: DataFrame, status: str) -> DataFrame:
    """``<status>, n, percent`` of all rows. The total is one number."""
    total = rows.count()
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n")).withColumn("percent", F.round(F.col("n") * 100 / F.lit(max(total, 1)), 4))


def run_parameters(run: str = "run") -> dict[str, Column]:
    """Parameters in a run's name: k-mer length, minimizer length and repetition; null where the name has none."""
    number = lambda letter: F.try_to_number(F.nullif(F.regexp_extract(run, f"{letter}([0-9]+)", 1), F.lit("")), F.lit("999")).cast("int")
    return {"k": number("k"), "m": number("m"), "rep": number("r")}


def rates(metrics: DataFrame) -> DataFrame:
    """Adds ``assignment_rate_tx``, ``assignment_rate_gene`` and ``unassigned_rate`` to rows of run counters."""
    of = lambda c: F.round(share(F.col(c), F.col("total_reads")), 6)
    return metrics.select(
        "*", of("assigned_tx").alias("assignment_rate_tx"), of("assigned_gene").alias("assignment_rate_gene"),
        F.round(share(F.col("ambiguous") + F.col("short"), F.col("total_reads")), 6).alias("unassigned_rate"),
    )


def quantiles_of(df: DataFrame, group: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """``key, <names>``: exact quantiles of a numeric column by group (``key`` is a struct of the group's columns), linearly interpolated.

    Nulls are passed over; null groups are groups. Values are counted and range-partitioned by (group, value), so a group of any size is
    spread over tasks; its ranks start after the counts of the partitions before, of which a window has one row each.
    """
    key = F.struct(*group) if group else F.struct(F.lit(0).alias("all"))
    counted = df.where(f"`{value}` is not null").groupBy(key.alias("key"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = written(counted.repartitionByRange("key", "v").withColumn("part", F.spark_partition_id()))
    along = Window.partitionBy("key")
    offset = F.coalesce(F.sum("in_part").over(along.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.groupBy("key", "part").agg(F.sum("n").alias("in_part")).select("key", "part", offset.alias("offset"), F.sum("in_part").over(along).alias("total"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.withColumn("before", before).join(offsets, ["key", "part"]).withColumn("rank", F.col("offset") + F.col("before"))
    holds = lambda r: F.max(F.when((F.col("rank") <= r) & (r < F.col("rank") + F.col("n")), F.col("v")))
    place = {name: (F.col("total") - 1) * q for name, q in at.items()}
    ends = [holds(end(p)).alias(f"{name}_{side}") for name, p in place.items() for side, end in (("low", F.floor), ("high", F.ceil))]
    found = ranked.groupBy("key").agg(F.max("total").alias("total"), *ends)
    between = lambda name, p: F.col(f"{name}_low") + (p - F.floor(p)) * (F.col(f"{name}_high") - F.col(f"{name}_low"))
    return found.select("key", *[between(name, p).alias(name) for name, p in place.items()])


def above_quantile(df: DataFrame, value: str, *, quantile: float = 0.5) -> DataFrame:
    """Adds ``above``: whether a value exceeds the exact quantile of the column (nulls passed over). The quantile is one number."""
    found = quantiles_of(df, [], value, {"bound": quantile}).first()
    return df.withColumn("above", F.col(value) > F.lit(found and found["bound"]).cast("double"))


def long_means(df: DataFrame, group: list[str], values: list[str], *, name: str = "metric") -> DataFrame:
    """``<group>, <name>, value``: the mean of each value column by group, one row for each column."""
    means = df.groupBy(*group).agg(*[F.avg(v).cast("double").alias(v) for v in values])
    return means.unpivot(group, values, name, "value").withColumn("value", F.round("value", 6))


def spread_of(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``n, mean, sd, lowest, median, q85, highest`` of a value by group; exact quantiles, linearly interpolated."""
    known = df.where(f"`{value}` is not null")
    spread = known.groupBy(F.struct(*group).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("sd"), F.min(value).alias("lowest"), F.max(value).alias("highest"),
    )
    both = spread.join(quantiles_of(known, group, value, {"median": 0.5, "q85": 0.85}), "key")
    return both.select("key.*", "n", "mean", "sd", "lowest", F.round("median", 4).alias("median"), F.round("q85", 4).alias("q85"), "highest")
