"""Per-key aggregation that stays balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import Written

#: A key is heavy from this share of all rows on; so there are at most 1 / HEAVY_SHARE heavy keys to broadcast.
HEAVY_SHARE = 0.001
SALTS = 64
#: Share of the rows from which the heavy keys are told. It decides about balance only, never about results.
LOOKED_AT = 0.02


def heavy_groups(df: DataFrame, key: str, member: str, *, share: float = HEAVY_SHARE, looked_at: float = LOOKED_AT, seed: int = 7) -> tuple[list, list]:
    """Keys, and pairs of key and member, that hold at least ``share`` of the rows looked at: at most ``1 / share`` of each.

    ``looked_at`` is the share of rows (drawn at random) that are counted, once for both.
    """
    named = df.select(F.col(key).alias("key"), F.col(member).alias("member"))
    seen = named if looked_at >= 1 else named.sample(looked_at, seed)
    counted = Written(seen.rollup("key", "member").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")))
    total = counted.df.where("level = 3").first()
    least = max(2, int((total["n"] if total else 0) * share))
    found = counted.df.where((F.col("n") >= least) & (F.col("level") < 3)).collect()
    counted.drop()
    return [r["key"] for r in found if r["level"] == 1], [(r["key"], r["member"]) for r in found if r["level"] == 0]


def salted_aggregate(
    df: DataFrame, key: str, *, member: str, lowest_highest: str | None = None, once: bool = False,
    share: float = HEAVY_SHARE, salts: int = SALTS, looked_at: float = LOOKED_AT,
) -> DataFrame:
    """Per key: rows, distinct members and, on request, the lowest and highest value of a column.

    Returns ``key, n_rows, n_members`` and, with ``lowest_highest``, ``lowest`` and ``highest``. Rows whose key is
    null are left out; a null member counts as a row, not as a member; nulls of ``lowest_highest`` are passed over
    (null where a key has nothing else). Repeated rows count as often as they occur; with ``once``, rows equal in
    key, member and ``lowest_highest`` count once. An empty table gives no rows. Only the named columns are read, so
    others may have any name.

    The rows of heavy keys get a random salt drawn from their member's hash: random with regard to the key, the
    same whenever a task is repeated, and equal for equal members, so that distinct members of different salts can be
    added up. Rows are shuffled once, by (key, salt); stage one drops repetitions, counts members and aggregates
    by (key, salt) where the rows then are; stage two merges these partial results by key. A pair of key and
    member that is heavy by itself (copies of one row, say) would not be split by that salt: the rows of such pairs
    are combined before their shuffle, by (key, member, value), and merged like the others.
    """
    value = F.col(lowest_highest) if lowest_highest else F.lit(None).cast("int")
    named = df.select(F.col(key).alias("key"), F.col(member).alias("member"), value.alias("value")).where("key is not null")
    keys, pairs = heavy_groups(named, "key", "member", share=share, looked_at=looked_at)
    is_heavy = F.col("key").isin(keys) if keys else F.lit(False)
    salt = F.when(is_heavy, F.pmod(F.xxhash64("member"), F.lit(salts))).otherwise(F.lit(0))
    kinds = dict(named.dtypes)
    ends = [F.min("lowest").alias("lowest"), F.max("highest").alias("highest")]

    def combined(rows: DataFrame, by: list[str]) -> DataFrame:
        """``by, n_rows, n_members, lowest, highest`` of rows by (by, member)."""
        if once:
            counted = rows.groupBy(*by, "member", "value").agg(F.lit(1).alias("n_rows")).select("*", F.col("value").alias("lowest"), F.col("value").alias("highest"))
            by_member = counted.groupBy(*by, "member").agg(F.count(F.lit(1)).alias("n_rows"), *ends)
        else:
            by_member = rows.groupBy(*by, "member").agg(F.count(F.lit(1)).alias("n_rows"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
        return by_member.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.count("member").alias("n_members"), *ends)

    if pairs:
        hot = F.broadcast(df.sparkSession.createDataFrame(pairs, f"hot_key {kinds['key']}, hot_member {kinds['member']}"))  # at most 1 / share rows
        same = F.col("key").eqNullSafe(F.col("hot_key")) & F.col("member").eqNullSafe(F.col("hot_member"))
        apart = combined(named.join(hot, same, "left_semi"), ["key"])
        named = named.join(hot, same, "left_anti")
    partial = combined(named.withColumn("salt", salt).repartition("key", "salt"), ["key", "salt"]).drop("salt")
    if pairs:
        partial = partial.unionByName(apart)
    merged = partial.groupBy("key").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_members").alias("n_members"), *ends)
    kept = ["n_rows", "n_members"] + ["lowest", "highest"] * bool(lowest_highest)
    return merged.select(F.col("key").alias(key), *kept)


def at_least_share(counts: DataFrame, count: str, share: float) -> DataFrame:
    """Rows of a counts table whose ``count`` is at least ``share`` of the column's total."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    return counts.where(F.col(count) >= F.lit(share) * F.lit(total))


def nucleotide_code(column: str) -> Column:
    """A minimizer in A, C, G, T: case is ignored and N has the code of G."""
    return F.translate(F.upper(F.col(column)), "N", "G")
