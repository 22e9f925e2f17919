"""Consolidating pairwise matches into groups: connected components by alternating star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.graph import with_lowest
from tallyloom.session import Written


def connected_components(edges: DataFrame, a: str, b: str, *, nodes: DataFrame | None = None) -> DataFrame:
    """``node, component`` for every record, component being the smallest record linked directly or indirectly.

    ``edges`` links its columns ``a`` and ``b`` (one orderable type) in either direction; links with a null, of a
    record to itself and repeated ones add nothing. ``nodes`` (first column) adds records without links, which
    are their own component; without it the records are the non-null values of ``a`` and ``b``. Other columns may
    have any name; an empty table gives no rows.

    Large-star and small-star rewrites alternate until the edges no longer change, however many rounds that takes;
    when their number and hashes are the same, the edges themselves are compared. Each round's edges are written to the
    shared folder, so nothing is recomputed when an executor is lost; superseded ones are removed.
    """
    x, y = F.col(a), F.col(b)
    ends = edges.select(x.alias("node")).union(edges.select(y.alias("node")))
    if nodes is not None:
        ends = ends.union(nodes.select(F.col(nodes.columns[0]).alias("node")))
    now = _written(edges.where(x != y).select(F.greatest(x, y).alias("high"), F.least(x, y).alias("low")).distinct())
    while True:
        large = _written(_large_star(now.df, now.values["n"]))
        after = _written(_small_star(large.df, large.values["n"]))
        large.drop()
        same = after.values == now.values and not after.df.join(now.df, ["high", "low"], "left_anti").limit(1).count()
        now.drop()
        now = after
        if same:
            break
    known = ends.where("node is not null").distinct()
    return known.join(now.df, known["node"] == now.df["high"], "left").select("node", F.coalesce("low", "node").alias("component"))


def _written(edges: DataFrame) -> Written:
    """Distinct edges, written; their number and a sum of their hashes are taken on the way."""
    return Written(edges, n=F.count(F.lit(1)), hashes=F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")))


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node's higher neighbours are linked to the lowest of the node and its neighbours."""
    both = edges.select(F.col("low").alias("node"), F.col("high").alias("other")).union(edges.select("high", "low"))
    lowest = both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.least(F.min("other"), F.first("node")).alias("lowest"))
    rewritten = with_lowest(edges.select(F.col("low").alias("node"), F.col("high").alias("other")), lowest, n_edges)
    return rewritten.select(F.col("other").alias("high"), F.col("lowest").alias("low")).distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node and its lower neighbours are linked to the lowest of them."""
    lower = edges.select(F.col("high").alias("node"), F.col("low").alias("other"))
    lowest = lower.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.min("other").alias("lowest"))
    moved = with_lowest(lower, lowest, n_edges).where(F.col("other") != F.col("lowest"))
    return (
        moved.select(F.col("other").alias("high"), F.col("lowest").alias("low"))
        .union(lowest.select(F.col("node").alias("high"), F.col("lowest").alias("low"))).distinct()
    )
