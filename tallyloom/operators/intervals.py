"""Interval operators: continuous periods and their gaps, overlap joins, best overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Starts are cut into slices of so many positions; after one row per start is kept, a slice holds no more rows than that.
SLICE_WIDTH = 65_536


def periods_and_gaps(
    df: DataFrame, entity: str, start: str, end: str, *, touching: bool = True, slice_width: int = SLICE_WIDTH
) -> DataFrame:
    """Continuous periods covered by the half-open intervals of each entity, and the gaps between them.

    Returns ``entity, kind, number, from_pos, to_pos`` with kind ``period`` or ``gap``; a gap has the number of
    the period that follows it. Rows with a null in one of the three columns, or with ``end <= start``, are no
    intervals. Repeated rows, ties and other columns of ``df`` (whatever their names) change nothing; an empty
    table gives an empty result. ``touching`` joins an interval that starts where the period before it ends.

    An entity may hold any share of the rows: starts are first reduced to one row each, then sorted and compared
    with the running maximum end within slices of ``slice_width`` positions. What crosses slices (the maximum end
    and the number of periods so far) is carried over one row per slice, of which 32-bit positions have at most
    2**31 / slice_width for an entity.
    """
    given = df.select(
        F.col(entity).alias("entity"), F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end")
    ).where("entity is not null and start is not null and end is not null and end > start")
    starts = given.groupBy("entity", "start").agg(F.max("end").alias("end"))
    sliced = starts.withColumn("slice", F.floor(F.col("start") / slice_width))

    earlier = Window.partitionBy("entity").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy("entity", "slice").agg(F.max("end").alias("top"))
        .select("entity", "slice", F.max("top").over(earlier).alias("carried_end"))
    )

    within = Window.partitionBy("entity", "slice").orderBy("start")
    so_far = within.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("start") > F.col("previous_end") if touching else F.col("start") >= F.col("previous_end")
    labelled = (
        sliced.join(carried, ["entity", "slice"])
        .withColumn("previous_end", F.greatest("carried_end", F.max("end").over(so_far)))
        .withColumn("opens", F.coalesce(opens, F.lit(True)))
        .withColumn("island", F.sum(F.col("opens").cast("bigint")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    )
    pieces = labelled.groupBy("entity", "slice", "island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max(F.when(F.col("opens"), F.col("previous_end"))).alias("gap_from"),
    )
    numbered = (
        pieces.groupBy("entity", "slice").agg(F.max("island").alias("islands"))
        .select("entity", "slice", F.coalesce(F.sum("islands").over(earlier), F.lit(0)).alias("islands_before"))
    )
    periods = (
        pieces.join(numbered, ["entity", "slice"])
        .withColumn("number", F.col("island") + F.col("islands_before"))
        .groupBy("entity", "number")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("gap_from").alias("gap_from"))
    )
    period = F.struct(F.lit("period").alias("kind"), F.col("start").alias("from_pos"), F.col("end").alias("to_pos"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("gap_from").alias("from_pos"), F.col("start").alias("to_pos"))
    return (
        periods.withColumn("row", F.explode(F.when(F.col("gap_from") < F.col("start"), F.array(period, gap)).otherwise(F.array(period))))
        .select("entity", "row.kind", "number", "row.from_pos", "row.to_pos")
    )


def depth_segments(df: DataFrame, entity: str, start: str, end: str, *, slice_width: int = SLICE_WIDTH) -> DataFrame:
    """``entity, from_pos, to_pos, depth``: stretches of equal depth, where intervals of an entity cover each other.

    Repeated rows add to the depth; rows with nulls or ``end <= start`` are no intervals; stretches of depth 0 are left
    out. Steps are aggregated per position first and summed up within slices, the depth at each slice's start and the
    position after its last one being carried over one row per slice.
    """
    given = df.select(
        F.col(entity).alias("entity"), F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end")
    ).where("entity is not null and start is not null and end is not null and end > start")
    both = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("step")))
    steps = given.select("entity", F.explode(both).alias("e")).groupBy("entity", "e.pos").agg(F.sum("e.step").alias("step"))
    sliced = steps.withColumn("slice", F.floor(F.col("pos") / slice_width))
    along = Window.partitionBy("entity").orderBy("slice")
    carried = (
        sliced.groupBy("entity", "slice").agg(F.sum("step").alias("total"), F.min("pos").alias("first"))
        .select(
            "entity", "slice", F.coalesce(F.sum("total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("depth_before"),
            F.lead("first").over(along).alias("next_first"),
        )
    )
    within = Window.partitionBy("entity", "slice").orderBy("pos")
    depth = F.col("depth_before") + F.sum("step").over(within.rowsBetween(Window.unboundedPreceding, 0))
    segments = sliced.join(carried, ["entity", "slice"]).select(
        "entity", F.col("pos").alias("from_pos"), F.coalesce(F.lead("pos").over(within), F.col("next_first")).alias("to_pos"), depth.alias("depth")
    )
    return segments.where("depth > 0")


def merged_loci(reads: DataFrame, entity: str, start: str, end: str, *, padding: int = 0) -> DataFrame:
    """``entity, from_pos, to_pos, n_reads``: loci of reads that lie within ``padding`` of each other, and how many each has."""
    widened = reads.where(f"`{entity}` is not null and `{end}` > `{start}`").select(F.col(entity).alias("read_on"), F.col(start).alias("read_from"), F.col(end).alias("read_to"))
    spans = widened.select("read_on", "read_from", (F.col("read_to") + padding).alias("padded_to"))
    loci = periods_and_gaps(spans, "read_on", "read_from", "padded_to").where("kind = 'period'").select("entity", "from_pos", (F.col("to_pos") - padding).alias("to_pos"))
    inside = overlap_join(widened, loci, left_on=("read_on", "read_from", "read_to"), right_on=("entity", "from_pos", "to_pos"))
    return inside.groupBy("entity", "from_pos", "to_pos").agg(F.count(F.lit(1)).alias("n_reads"))


def neighbours(df: DataFrame, entity: str, start: str, key: str, *, slice_width: int = SLICE_WIDTH) -> DataFrame:
    """``entity, left, right``: each key of an entity with the key that follows it by (start, key).

    A key has its least start in each entity; rows with a null in one of the three columns have no place. Keys are
    ordered within slices of ``slice_width`` positions; the first key of the next slice is carried over one row per slice.
    """
    given = df.select(F.col(entity).alias("entity"), F.col(start).cast("bigint").alias("start"), F.col(key).alias("left"))
    places = given.where("entity is not null and start is not null and left is not null").groupBy("entity", "left").agg(F.min("start").alias("start"))
    sliced = places.withColumn("slice", F.floor(F.col("start") / slice_width))
    first = sliced.groupBy("entity", "slice").agg(F.min(F.struct("start", "left"))["left"].alias("first"))
    carried = first.select("entity", "slice", F.lead("first").over(Window.partitionBy("entity").orderBy("slice")).alias("next_first"))
    following = F.lead("left").over(Window.partitionBy("entity", "slice").orderBy("start", "left"))
    joined = sliced.withColumn("following", following).join(carried, ["entity", "slice"])
    return joined.select("entity", "left", F.coalesce("following", "next_first").alias("right")).where("right is not null")


def overlap_join(
    left: DataFrame, right: DataFrame, *, left_on: tuple[str, str, str], right_on: tuple[str, str, str],
    bin_width: int = 16_384, how: str = "inner",
) -> DataFrame:
    """Pairs of half-open intervals of the same entity that share at least one position.

    ``left_on`` and ``right_on`` name entity, start and end; all columns of both sides are kept, so their names
    have to differ. Both sides are exploded into bins of ``bin_width`` positions and joined on (entity, bin); a
    pair is kept in the bin of the later start only, so none comes out twice. ``how`` may be ``inner`` or
    ``left`` (left rows without a partner, or with nulls, come out once with nulls on the right).
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    if how not in ("inner", "left"):
        raise ValueError(f"how is {how!r}")
    (le, ls, ln), (re_, rs, rn) = left_on, right_on

    def binned(df: DataFrame, start: str, end: str, name: str) -> DataFrame:
        last = F.greatest(F.col(start), F.col(end) - 1)
        return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / bin_width), F.floor(last / bin_width))))

    valid_left = left.where(f"`{le}` is not null and `{ls}` is not null and `{ln}` > `{ls}`")
    valid_right = right.where(f"`{re_}` is not null and `{rs}` is not null and `{rn}` > `{rs}`")
    pairs = (
        binned(valid_left, ls, ln, "__left_bin")
        .join(
            binned(valid_right, rs, rn, "__right_bin"),
            (F.col(le) == F.col(re_)) & (F.col("__left_bin") == F.col("__right_bin")),
        )
        .where((F.col(ls) < F.col(rn)) & (F.col(rs) < F.col(ln)))
        .where(F.floor(F.greatest(F.col(ls), F.col(rs)) / bin_width) == F.col("__left_bin"))
        .drop("__left_bin", "__right_bin")
    )
    if how == "inner":
        return pairs
    found = pairs.select(*left.columns).distinct()
    same = [left[c].eqNullSafe(found[c]) for c in left.columns]
    return pairs.unionByName(left.join(found, same, "left_anti"), allowMissingColumns=True)


def best_overlap(
    left: DataFrame, right: DataFrame, *, left_id: str, right_id: str,
    left_on: tuple[str, str, str], right_on: tuple[str, str, str], padding: int = 0,
) -> DataFrame:
    """For each left interval, the right interval (widened by ``padding``) that shares most positions with it.

    Ties go to the smallest ``right_id``. The best partner is an aggregate, so no group is sorted in one task.
    """
    widened = right.withColumn("__start", F.col(right_on[1]) - padding).withColumn("__end", F.col(right_on[2]) + padding)
    pairs = overlap_join(left, widened, left_on=left_on, right_on=(right_on[0], "__start", "__end"))
    shared = F.least(F.col(left_on[2]), F.col("__end")) - F.greatest(F.col(left_on[1]), F.col("__start"))
    best = F.min(F.struct((-shared).alias("minus_shared"), F.col(right_id).alias("id")))
    return (
        pairs.groupBy(left_id).agg(best.alias("best"))
        .select(left_id, F.col("best.id").alias(right_id), (-F.col("best.minus_shared")).alias("shared"))
    )
