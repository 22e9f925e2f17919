import math

import pytest
from tests.helpers import rows

from tallyloom.operators.compare import table_differences

SCHEMA = "run string, id string, n bigint, cpm double, note string, difference string, n_rows int"


def found(spark, a, b, share=1e-3):
    one, two = (spark.createDataFrame([(*r, "x", "y", 1) for r in t], SCHEMA) for t in (a, b))
    return table_differences(one, two, ["run", "id"], ["n", "cpm"], tolerance={"cpm": share})


def differences(spark, a, b):
    return rows(found(spark, a, b), "run", "id", "difference", "n_rows")


def brute(a, b, share):
    def same(x, y):
        if x is None or y is None or math.isnan(x) or math.isnan(y):
            return (x is None) == (y is None) and (x is None or math.isnan(x) == math.isnan(y))
        return x == y or (not math.isinf(x) and not math.isinf(y) and abs(x - y) <= share * max(abs(x), abs(y)))

    sides = [{}, {}]
    for side, given in zip(sides, (a, b), strict=True):
        for r in given:
            side.setdefault(r[:2], set()).add(r[2:])
    for key in {*sides[0], *sides[1]}:
        left, right = (side.get(key, set()) for side in sides)
        if not right or not left:
            yield (*key, "missing_in_left" if right else "missing_in_right", len(left | right))
            continue
        for i, name in enumerate(("n", "cpm")):
            like = (lambda x, y: x == y) if i == 0 else same
            xs, ys = {v[i] for v in left}, {v[i] for v in right}
            if any(not any(like(x, y) for y in ys) for x in xs) or any(not any(like(x, y) for x in xs) for y in ys):
                yield (*key, name, 1)


def test_differences(spark):
    a = [("r", "same", 1, 1.0), ("r", "same", 1, 1.0), ("r", "left", 1, 1.0), ("r", "field", 1, 1.0), ("r", "near", 1, 1.0), ("r", "far", 1, 1.0), ("r", "null", None, None), ("r", "nulls", None, 2.0)]
    b = [("r", "same", 1, 1.0), ("r", "right", 1, 1.0), ("r", "field", 2, 3.0), ("r", "near", 1, 1.0009), ("r", "far", 1, 1.002), ("r", "null", 3, 1.0), ("r", "nulls", None, 2.0)]
    assert differences(spark, a, b) == [
        ("r", "far", "cpm", 1), ("r", "field", "cpm", 1), ("r", "field", "n", 1), ("r", "left", "missing_in_right", 1),
        ("r", "null", "cpm", 1), ("r", "null", "n", 1), ("r", "right", "missing_in_left", 1),
    ]
    shown = {(r.id, r.difference): (r.left_value, r.right_value) for r in found(spark, a, b).collect()}
    assert shown[("field", "n")] == ("1", "2") and shown[("null", "cpm")] == (None, "1.0") and shown[("left", "missing_in_right")] == (None, None)


def test_null_keys_and_several_versions(spark):
    a = [(None, "k", 1, 1.0), ("r", None, 1, 1.0), ("r", "two", 1, 1.0), ("r", "two", 2, 1.0), ("r", "part", 1, 1.0), ("r", "part", 2, 1.0), ("r", "close", 1, 1.0), ("r", "close", 1, 1.0001)]
    b = [(None, "k", 1, 1.0), ("r", None, 2, 1.0), ("r", "two", 3, 1.0), ("r", "part", 1, 1.0), ("r", "close", 1, 1.0)]
    assert differences(spark, a, b) == [("r", "part", "n", 1), ("r", "two", "n", 1), ("r", None, "n", 1)]


def test_against_brute_force(spark, rng):
    near = [1.0, 1.0009, 1.0018, 0.9991, -1.0, -1.0009, 0.0, -0.0, 1e-300, float("inf"), float("-inf"), float("nan"), None, 5e8, 5.004e8]
    sides = [[(rng.choice(["r", None]), rng.choice([None, *map(str, range(60))]), rng.choice([None, 1, 1, 2]), rng.choice(near)) for _ in range(200)] for _ in "ab"]
    assert differences(spark, *sides) == sorted(brute(*sides, 1e-3), key=lambda t: [(v is None, str(type(v)), v) for v in t])


def test_a_key_of_many_versions(spark):
    a = [("r", "hot", i, 1.0) for i in range(3000)]
    b = [("r", "hot", i, 1.0) for i in range(1, 3000)] + [("r", "hot", 9999, 1.0)]
    only = found(spark, a, b).collect()
    assert [tuple(r) for r in only] == [("r", "hot", "n", 1, "0", "9999")]


def test_empty_sides_and_bad_tolerance(spark):
    assert differences(spark, [], []) == []
    assert differences(spark, [("r", "k", 1, None)], []) == [("r", "k", "missing_in_right", 1)]
    with pytest.raises(ValueError):
        found(spark, [], [], share=1.0)
