"""Filling fixed-capacity containers with texts measured in tokens, by vector best-fit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import spread, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of this public vocabulary.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items packed together; what they leave unused is at most their last few containers.
ITEMS_A_BLOCK = 4096
#: Partitions at most; beyond, each packs several blocks.
MOST_PARTITIONS = 20_000
#: Attention cost that a container may have, as a share of that of one text that fills it.
COST_SHARE = 0.8
_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    """The tokenizer of a vocabulary file, read once in each Python worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(df: DataFrame, key: str, text: str, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """``item, n_tokens`` of each row; whole texts are tokenized. A null or empty text has 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            counts = [len(encode(t.encode("utf-8", "replace").decode())) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["item", "n_tokens"])

    given = spread(df.select(F.col(key).alias("item"), F.col(text).cast("string").alias("text")))
    return given.mapInArrow(count, f"item {dict(given.dtypes)['item']}, n_tokens bigint")


def best_fit(sizes: np.ndarray, capacity: int, most_items: int, most_cost: float, *, rule: str = "norm") -> np.ndarray:
    """The bin of each item, items taken from the largest to the smallest.

    An item needs ``size`` tokens, one place and ``size ** 2`` attention cost; a bin offers it a place only if all
    three residual capacities allow. Of those bins, ``norm`` takes the one whose residual, in shares of the
    capacities, is shortest after the item is in; ``dot`` the one whose residual has the largest weighted
    dot-product with the item. Weights are the shares of each capacity that all items together need, so that the
    scarcest resource counts most. Ties go to the bin opened first. An item that alone exceeds ``most_cost`` has a bin of
    its own, as no other could offer it less.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule is {rule!r}")
    limits = np.array([capacity, most_items, most_cost], float)
    needs = np.stack([sizes, np.ones(len(sizes)), sizes.astype(float) ** 2], 1) / limits
    if len(needs) and needs[:, :2].max() > 1:
        raise ValueError("an item exceeds the capacity")
    weights = needs.sum(0) / max(needs.sum(), 1e-12)
    bins, left, n_open = np.empty(len(sizes), np.int64), np.ones((max(len(sizes), 1), 3)), 0
    for i in np.argsort(-sizes, kind="stable"):
        need, open_bins = needs[i], left[:n_open]
        fits = np.flatnonzero((open_bins >= need - 1e-12).all(1))
        if not len(fits):
            chosen, n_open = n_open, n_open + 1
        elif rule == "norm":
            chosen = fits[(((open_bins[fits] - need) ** 2) @ weights).argmin()]
        else:
            chosen = fits[(open_bins[fits] @ (weights * need)).argmax()]
        left[chosen] = left[chosen] - need if need[2] <= 1 else -1.0
        bins[i] = chosen
    return bins


def pack_items(
    counts: DataFrame, *, capacity: int = 2048, most_items: int = 64, most_cost: float | None = None,
    rule: str = "norm", items_a_block: int = ITEMS_A_BLOCK,
) -> DataFrame:
    """Containers for items measured by ``token_counts``: ``item, piece, from_token, to_token, n_tokens, container``.

    Only an item larger than ``capacity`` is split: into full pieces, each a container of its own, and the rest,
    which is packed like an item. ``most_cost`` bounds the sum of squared lengths (attention within each text) of a
    container; by default it is ``COST_SHARE`` of that of one text that fills a container. A single text above it, which may not be
    split, has a container of its own. An item of no tokens takes a place only. Each given row is an item of its own, also
    where keys are null or repeated; an empty table gives no rows.

    Items are dealt at random (by a hash of their row) to an explicit number of partitions, and there packed by ``best_fit`` in
    blocks of ``items_a_block`` to twice as many; so tasks are equal whatever the keys, hold one block at a time, and at most one or
    two containers of a block are left partly filled. Container names are unique over all partitions.
    """
    most_cost = float(capacity**2 * COST_SHARE if most_cost is None else most_cost)
    if most_cost <= 0:
        raise ValueError("most_cost is to be above 0")
    fixed = written(counts.select("item", "n_tokens", F.monotonically_increasing_id().alias("row")))
    partitions = min(MOST_PARTITIONS, max(1, fixed.count() // items_a_block))
    kind = dict(counts.dtypes)["item"]

    def packed(table: pa.Table, name: str) -> pa.Table:
        size = table["n_tokens"].to_numpy()
        full, rest = size // capacity, size % capacity
        loose = np.flatnonzero((rest > 0) | (size == 0))
        bins = best_fit(rest[loose], capacity, most_items, most_cost, rule=rule)
        n_bins = int(bins.max()) + 1 if len(bins) else 0
        whole = np.repeat(np.arange(len(size)), full)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        owner = np.r_[whole, loose]
        start = np.r_[piece * capacity, full[loose] * capacity]
        length = np.r_[np.full(len(whole), capacity), rest[loose]]
        names = np.r_[n_bins + np.arange(len(whole)), bins]
        return pa.table({
            "item": table["item"].take(pa.array(owner)), "piece": pa.array(np.r_[piece, full[loose]].astype(np.int64)),
            "from_token": pa.array(start), "to_token": pa.array(start + length), "n_tokens": pa.array(length),
            "container": pa.array([f"{name}-{n}" for n in names]),
        })

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, partition = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows >= 2 * items_a_block:
                yield from packed(held.slice(0, items_a_block), f"{partition}-{block}").to_batches()
                held, block = held.slice(items_a_block), block + 1
        if held is not None and held.num_rows:
            yield from packed(held, f"{partition}-{block}").to_batches()

    schema = f"item {kind}, piece bigint, from_token bigint, to_token bigint, n_tokens bigint, container string"
    dealt = fixed.repartition(partitions, F.xxhash64("row")).sortWithinPartitions("row")
    return dealt.select("item", "n_tokens").mapInArrow(pack, schema)


def container_loads(packed: DataFrame) -> DataFrame:
    """``container, n_tokens, n_places, cost, longest``: what each container of ``pack_items`` holds."""
    n = F.col("n_tokens")
    return packed.groupBy("container").agg(
        F.sum(n).alias("n_tokens"), F.count(F.lit(1)).alias("n_places"), F.sum(n * n).alias("cost"), F.max(n).alias("longest")
    )
