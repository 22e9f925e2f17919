"""Differences between two copies of a table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import written


def _told(column: Column, kind: str) -> Column:
    """A text that two values of an exact field share only if they are the same."""
    if kind in ("float", "double"):
        return (column + F.lit(0.0)).cast("string")  # -0.0 is 0.0
    return F.unix_micros(column).cast("string") if kind == "timestamp" else column.cast("string")


def _stretch(x: Column, tolerance: float) -> Column:
    """The stretch of values that a double lies in; two values of one stretch are the same within the tolerance.

    Stretches are slightly narrower than the tolerance, so that rounding cannot break this. Values within the tolerance
    of each other are then at most two stretches apart. Zero, infinities and NaN are stretches of their own.
    """
    number = F.floor(F.log(F.abs(x)) / F.lit(-math.log1p(-tolerance) * 0.999))
    special = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(x == 0, "0").when(special, x.cast("string")).otherwise(F.concat(F.when(x < 0, "-").otherwise("+"), number.cast("string")))


def _with_near(code: Column) -> Column:
    """A stretch and the four next to it; nulls for these where it is not a numbered one."""
    number = F.expr("try_cast(substring(code, 2) as bigint)")
    return F.array(code, *[F.concat(F.substring(code, 1, 1), (number + by).cast("string")) for by in (-2, -1, 1, 2)])


def table_differences(
    left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], *,
    tolerance: dict[str, float] | None = None, missing_in_left: str = "missing_in_left", missing_in_right: str = "missing_in_right",
) -> DataFrame:
    """Rows missing on either side and, for keys known on both, every field that differs.

    Both sides come normalised (spelling, blanks, empty strings). Returns ``keys..., difference, n_rows, left_value,
    right_value``: one row per key found on one side only (``n_rows`` of its versions), and one per differing field
    (``n_rows`` is 1). Only keys and fields are compared; other columns may have any name. Rows equal in all of them count
    once within a side. Null equals only null, in keys as in fields; NaN equals NaN. ``tolerance`` gives, for a numeric
    field, the share (above 0, below 1) of the larger absolute value up to which two values are the same.

    A key may have several different versions on a side. It is missing only if the other side has none; a field
    differs if a side has a value of it that no version of the other side has (within the tolerance). Shown are, of each
    side, the least such value, or its least value where all have a partner (least as text).

    Fields with a tolerance are normalised to stretches of values; EXCEPT ALL in both directions leaves the residues,
    whose keys are joined in full. The versions of these keys alone are then compared value by value, in joins on (key,
    field, value), for which they are written to the shared folder: a key of any number of versions is spread over its values.
    """
    tolerance = tolerance or {}
    if bad := [f for f, share in tolerance.items() if not 0 < share < 1 or f not in fields]:
        raise ValueError(f"tolerances of {bad}")
    kinds = dict(left.dtypes)

    def sided(df: DataFrame) -> DataFrame:
        key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
        return df.select(key.alias("key"), *[F.col(f).cast("double" if f in tolerance else kinds[f]).alias(f"f{i}") for i, f in enumerate(fields)])

    sides = {"l": sided(left), "r": sided(right)}
    normalised = [_stretch(F.col(f"f{i}"), tolerance[f]).alias(f"f{i}") if f in tolerance else F.col(f"f{i}") for i, f in enumerate(fields)]
    a, b = (side.select("key", *normalised).distinct() for side in sides.values())
    touched = a.exceptAll(b).select("key").distinct().join(b.exceptAll(a).select("key").distinct(), "key", "full")

    def entry(i: int, f: str) -> Column:
        value = F.col(f"f{i}")
        number = value if f in tolerance else F.lit(None).cast("double")
        code = _stretch(value, tolerance[f]) if f in tolerance else _told(value, kinds[f])
        return F.struct(F.lit(i).alias("field"), code.alias("code"), value.cast("string").alias("text"), number.alias("number"))

    none = F.lit(None).cast("string")
    whole = F.struct(F.lit(-1).alias("field"), none.alias("code"), none.alias("text"), F.lit(None).cast("double").alias("number"))
    entries = F.array(whole, *[entry(i, f) for i, f in enumerate(fields)])
    versions = [side.join(touched, "key", "left_semi").distinct().select("key", F.lit(name).alias("side"), F.explode(entries).alias("e")) for name, side in sides.items()]
    of = lambda name: F.count_if(F.col("side") == name).alias(f"{name}_n")
    # read several times below, so written once; it holds the residues' keys only
    values = written(versions[0].union(versions[1]).select("key", "side", "e.*").groupBy("key", "field", "code", "text", "number").agg(of("l"), of("r")))
    on = lambda side, c: F.when(F.col(f"{side}_n") > 0, F.col(c))
    alone = (F.col("l_n") == 0) | (F.col("r_n") == 0)
    if tolerance:
        measured = values.where("number is not null")
        by_code = measured.groupBy("key", "field", "code").agg(
            *[how(on(s, "number")).alias(f"{s}_{name}") for s in "lr" for name, how in (("low", F.min), ("high", F.max))]
        )
        share = F.element_at(F.array(*[F.lit(tolerance.get(f, 0.0)) for f in fields]), F.col("field") + 1)
        close = lambda c: F.col("own") | (F.abs(F.col("number") - F.col(c)) <= share * F.greatest(F.abs("number"), F.abs(c)))
        asked = measured.where(alone).select("key", "field", "text", "number", "l_n", F.col("code").alias("of"), F.explode(_with_near(F.col("code"))).alias("code"))
        other = F.when(F.col("l_n") > 0, F.coalesce(close("r_low") | close("r_high"), F.lit(False)) & F.col("r_low").isNotNull())
        other = other.otherwise(F.coalesce(close("l_low") | close("l_high"), F.lit(False)) & F.col("l_low").isNotNull())
        met = asked.join(by_code, ["key", "field", "code"]).withColumn("own", F.col("of") == F.col("code")).where(other)
        met = met.select("key", "field", "text").distinct().withColumn("met", F.lit(True))
        marked = values.join(met, ["key", "field", "text"], "left").withColumn("lone", alone & F.col("met").isNull())
    else:
        marked = values.withColumn("lone", alone)
    least = lambda s, lone: F.min(F.when(F.col("lone") == lone, on(s, "text")))
    shown = lambda s: F.when(F.count_if(F.col("lone") & (F.col(f"{s}_n") > 0)) > 0, least(s, True)).otherwise(least(s, False)).alias(f"{s}_value")
    per_field = marked.groupBy("key", "field").agg(
        F.count_if("lone").alias("n_lone"), F.max("l_n").alias("l_n"), F.max("r_n").alias("r_n"), shown("l"), shown("r")
    )
    found = F.when((F.col("field") >= 0) & (F.col("n_lone") > 0), F.struct("field", F.col("l_value").alias("left_value"), F.col("r_value").alias("right_value")))
    per_key = per_field.groupBy("key").agg(  # at most one entry for each field
        *[F.max(F.when(F.col("field") < 0, F.col(f"{s}_n"))).alias(f"{s}_rows") for s in "lr"], F.collect_list(found).alias("found")
    )
    line = lambda difference, n, x, y: F.struct(difference.alias("difference"), n.cast("bigint").alias("n_rows"), x.alias("left_value"), y.alias("right_value"))
    names = F.array(*[F.lit(f) for f in fields])
    lines = (
        F.when(F.col("r_rows") == 0, F.array(line(F.lit(missing_in_right), F.col("l_rows"), none, none)))
        .when(F.col("l_rows") == 0, F.array(line(F.lit(missing_in_left), F.col("r_rows"), none, none)))
        .otherwise(F.transform("found", lambda e: line(F.element_at(names, e["field"] + 1), F.lit(1), e["left_value"], e["right_value"])))
    )
    return per_key.select("key", F.explode(lines).alias("e")).select(*[F.col(f"key.k{i}").alias(k) for i, k in enumerate(keys)], "e.*")
