from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyloom.llm.packing import best_fit, pack_items, token_counts


def packed(spark, sizes, **options):
    counts = spark.createDataFrame(list(enumerate(sizes)), "item bigint, n_tokens bigint")
    return [r.asDict() for r in pack_items(counts, **options).collect()]


def check(sizes, found, capacity, most_items):
    load, places, pieces = Counter(), Counter(), defaultdict(list)
    for r in found:
        load[r["container"]] += r["n_tokens"]
        places[r["container"]] += 1
        assert r["to_token"] - r["from_token"] == r["n_tokens"]
        pieces[r["item"]].append((r["from_token"], r["to_token"]))
    assert max(load.values()) <= capacity and max(places.values()) <= most_items
    for item, size in enumerate(sizes):
        own = sorted(pieces[item])
        assert own[0][0] == 0 and own[-1][1] == size and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        assert len(own) == max(1, -(-size // capacity))
    return load


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_whole_items_fit(spark, rng, rule):
    sizes = [rng.choice([0, 1, 100, 100, 100, 2048, 2049, 5000, rng.randrange(1, 2048)]) for _ in range(600)]
    found = packed(spark, sizes, rule=rule, items_a_block=100)
    load = check(sizes, found, 2048, 64)
    assert sum(load.values()) == sum(sizes)
    assert sum(load.values()) / (2048 * len(load)) > 0.95


def test_place_limit_and_bad_limits(spark):
    sizes = [1] * 50
    check(sizes, packed(spark, sizes, most_items=4), 2048, 4)
    with pytest.raises(ValueError):
        packed(spark, sizes, most_cost=0)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_cost_limit_binds(spark, rng, rule):
    """A limit below capacity ** 2 keeps texts apart that would fit by their tokens; only a single text may exceed it."""
    sizes = [rng.choice([1000, 1000, 900, 1100, 1900, 2048, 30, rng.randrange(1, 2048)]) for _ in range(300)]
    limit = 2048**2 / 2
    found = packed(spark, sizes, rule=rule, most_cost=limit)
    check(sizes, found, 2048, 64)
    cost, places = Counter(), Counter()
    for r in found:
        cost[r["container"]] += r["n_tokens"] ** 2
        places[r["container"]] += 1
    assert all(cost[c] <= limit or places[c] == 1 for c in cost)
    free, shared = Counter(), Counter()
    for r in packed(spark, sizes, rule=rule, most_cost=2048.0**2):
        free[r["container"]] += r["n_tokens"] ** 2
        shared[r["container"]] += 1
    assert any(free[c] > limit and shared[c] > 1 for c in free)  # what the limit keeps apart


def test_several_tasks_pack(spark):
    counts = spark.range(5000).selectExpr("id as item", "1 + id * 7 % 2048 as n_tokens")
    result = pack_items(counts, items_a_block=500)
    assert len({r["container"].split("-")[0] for r in result.collect()}) == 10


def test_cost_of_bins():
    bins = best_fit(np.array([10] * 12), 100, 64, 300.0)
    assert max(Counter(bins.tolist()).values()) == 3
    assert sorted(best_fit(np.array([20, 20, 5]), 100, 64, 300.0).tolist()) == [0, 1, 2]
    with pytest.raises(ValueError):
        best_fit(np.array([101]), 100, 64, 1e9)


def test_close_to_the_least_possible(rng):
    """At most one bin in nine more than needed, on sizes that could fill bins."""
    sizes = np.array([rng.randrange(1, 1025) for _ in range(2000)])
    for rule in ("norm", "dot"):
        assert best_fit(sizes, 2048, 64, 2048.0**2, rule=rule).max() + 1 <= 1.02 * -(-sizes.sum() // 2048)


def test_tokens_round_trip(spark):
    texts = [None, "", "one two three", "Grüße 123 <|endoftext|>", "x" * 50_000, "a\u200bb \U0001f600" * 10]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc bigint, body string, item int, text string")
    got = {r.item: r.n_tokens for r in token_counts(docs, "doc", "body").collect()}
    from tallyloom.llm.packing import TOKENIZER, _encoding

    encoding = _encoding(TOKENIZER)
    for i, t in enumerate(texts):
        tokens = encoding.encode_ordinary(t or "")
        assert encoding.decode(tokens) == (t or "") and got[i] == len(tokens)


def test_repeated_and_null_keys_and_empty(spark):
    counts = spark.createDataFrame([(None, 5), (None, 5), (1, 7), (1, 7)], "item bigint, n_tokens bigint")
    assert sorted(r.n_tokens for r in pack_items(counts).collect()) == [5, 5, 7, 7]
    assert pack_items(counts.where("false")).count() == 0
