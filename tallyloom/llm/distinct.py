"""Exact distinct counts over huge identifier sets with compressed, mergeable bitmaps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import shared_folder, spread, written

#: Codes of a bucket; a bitmap has one bit for each.
BUCKET = 32_768
#: Up to so many members a bitmap is kept as their sorted 16-bit positions, beyond as plain bits; neither exceeds 4096 bytes.
FEW = BUCKET // 16
#: Pairs of code and cell that a task holds before it emits their bitmaps, and bitmaps that it ORs at once. They bound its memory.
MOST_WAITING = 2_000_000
MOST_ROWS = 2048


def pack(positions: np.ndarray) -> bytes:
    """A compressed bitmap of distinct positions below ``BUCKET``."""
    if len(positions) < FEW:
        return np.sort(positions).astype("<u2").tobytes()
    bits = np.zeros(BUCKET, np.uint8)
    bits[positions] = 1
    return np.packbits(bits).tobytes()


def unpack(bitmap: bytes) -> np.ndarray:
    """The plain bits of a compressed bitmap, eight to a byte."""
    if len(bitmap) == BUCKET // 8:
        return np.frombuffer(bitmap, np.uint8)
    bits = np.zeros(BUCKET, np.uint8)
    bits[np.frombuffer(bitmap, "<u2")] = 1
    return np.packbits(bits)


def or_groups(bitmaps: list[bytes], group: np.ndarray, n_groups: int) -> tuple[list[bytes], np.ndarray]:
    """The OR of the bitmaps of each group (numbered from 0), and how many bits it has. A lone bitmap of a group stays as it is."""
    lone = np.bincount(group, minlength=n_groups)[group] == 1
    if not lone.any():
        return _or_groups(bitmaps, group, n_groups)
    ored: list[bytes] = [b""] * n_groups
    counts = np.zeros(n_groups, np.int64)
    others = np.flatnonzero(~lone)
    if len(others):
        numbers, own = np.unique(group[others], return_inverse=True)
        found, bits = _or_groups([bitmaps[i] for i in others], own, len(numbers))
        counts[numbers] = bits
        for number, bitmap in zip(numbers, found, strict=True):
            ored[number] = bitmap
    for i in np.flatnonzero(lone):
        bitmap = bitmaps[i]
        ored[group[i]] = bitmap
        counts[group[i]] = len(bitmap) // 2 if len(bitmap) < BUCKET // 8 else np.bitwise_count(np.frombuffer(bitmap, np.uint8)).sum(dtype=np.int64)
    return ored, counts


def _or_groups(bitmaps: list[bytes], group: np.ndarray, n_groups: int) -> tuple[list[bytes], np.ndarray]:
    size = np.array([len(b) for b in bitmaps], np.int64)
    plain = size == BUCKET // 8
    few = np.frombuffer(b"".join(b for b, p in zip(bitmaps, plain, strict=True) if not p), "<u2")
    members = np.unique(np.repeat(group[~plain], size[~plain] // 2).astype(np.int64) * BUCKET + few)
    of, at = members // BUCKET, members % BUCKET
    counts = np.bincount(of, minlength=n_groups)
    big = counts >= FEW
    big[group[plain]] = True
    rows = np.flatnonzero(big)
    bits = np.zeros((len(rows), BUCKET // 8), np.uint8)
    place = np.zeros(n_groups, np.int64)
    place[rows] = np.arange(len(rows))
    if len(rows):
        own = big[of]
        np.bitwise_or.at(bits.reshape(-1), place[of[own]] * (BUCKET // 8) + at[own] // 8, (128 >> (at[own] % 8)).astype(np.uint8))
    if plain.any():
        given = np.frombuffer(b"".join(b for b, p in zip(bitmaps, plain, strict=True) if p), np.uint8).reshape(-1, BUCKET // 8)
        order = np.argsort(group[plain], kind="stable")
        sorted_groups = group[plain][order]
        starts = np.flatnonzero(np.r_[True, sorted_groups[1:] != sorted_groups[:-1]])
        bits[place[sorted_groups[starts]]] |= np.bitwise_or.reduceat(given[order], starts, axis=0)
    counts[rows] = np.bitwise_count(bits).sum(1, dtype=np.int64)
    ends = np.searchsorted(of, np.arange(n_groups + 1))
    small = at.astype("<u2")
    ored = [bits[place[g]].tobytes() if big[g] else small[ends[g] : ends[g + 1]].tobytes() for g in range(n_groups)]
    return ored, counts


def _codes(table: pa.Table, names: list[str]) -> np.ndarray:
    """A number for each row, equal where the named columns are (nulls included)."""
    code = np.zeros(table.num_rows, np.int64)
    for name in names:
        values = table[name].combine_chunks().dictionary_encode(null_encoding="encode")
        code = np.unique(code * max(len(values.dictionary), 1) + values.indices.to_numpy(), return_inverse=True)[1]
    return code


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([]).to_batches()


class IdentifierDictionary:
    """The codes of identifiers, kept in a folder so that bitmaps of different runs can be merged.

    A code is dense within its kind and shard. The number of shards is fixed when the dictionary is made, and kept with it;
    so are its kinds. Later runs look up the codes of known identifiers and add the new ones. One run may write at a time.
    """

    def __init__(self, spark: SparkSession, kinds: list[str], *, path: str | None = None, shards: int | None = None) -> None:
        self.spark = spark
        self.kept = path is not None
        self.path = path or f"{shared_folder(spark)}/tallyloom-{uuid.uuid4().hex}"
        if not self._has("meta"):
            given = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(given, kinds)], "shards int, kinds array<string>").write.parquet(f"{self.path}/meta")
        self.shards, self.kinds = spark.read.parquet(f"{self.path}/meta").first()
        if shards not in (None, self.shards) or not set(kinds) <= set(self.kinds):
            raise ValueError(f"the dictionary has {self.shards} shards and the kinds {self.kinds}")

    def _has(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def entries(self) -> DataFrame:
        """``kind`` (its number), ``shard, id, code``."""
        schema = "kind int, shard int, id string, code bigint"
        return self.spark.read.schema(schema).parquet(f"{self.path}/entries") if self._has("entries") else self.spark.createDataFrame([], schema)

    def sizes(self) -> dict[tuple[int, int], int]:
        """How many codes each (kind, shard) has: no more rows than kinds times shards."""
        rows = self.entries().groupBy("kind", "shard").agg(F.max("code").alias("last")).collect()
        return {(r["kind"], r["shard"]): r["last"] + 1 for r in rows}

    def add(self, entries: DataFrame) -> None:
        entries.write.mode("append").parquet(f"{self.path}/entries")


def _encoder(sizes: dict[tuple[int, int], int], keep: bool):
    """Scans the sorted identifiers of a shard: known ones have their code, new ones get the next; bucket by bucket, emits each cell's bitmap."""
    names = ["kind", "cell", "shard", "bucket", "bitmap", "id", "code"]

    def bitmaps(kind: int, shard: int, codes: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
        buckets, codes = codes // BUCKET, codes % BUCKET
        order = np.lexsort((codes, cells, buckets))
        buckets, cells, codes = buckets[order], cells[order], codes[order]
        other = (cells[1:] != cells[:-1]) | (buckets[1:] != buckets[:-1])
        fresh = np.r_[True, other | (codes[1:] != codes[:-1])]
        starts = np.flatnonzero(np.r_[True, other][fresh])
        buckets, cells, codes = buckets[fresh], cells[fresh], codes[fresh]
        n = len(starts)
        packed = [pack(part) for part in np.split(codes, starts[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(cells[starts]), pa.array(np.full(n, shard, np.int32)), pa.array(buckets[starts]),
             pa.array(packed, pa.binary()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names,
        )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        last, code, open_kind, following, waiting, n_waiting = (None, None), -1, None, 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds, ids, cells, known = batch.columns
            first = np.ones(batch.num_rows, bool)
            first[1:] = pc.or_(pc.not_equal(ids[1:], ids[:-1]), pc.not_equal(kinds[1:], kinds[:-1])).to_numpy(zero_copy_only=False)
            first[0] = (kinds[0].as_py(), ids[0].as_py()) != last
            kind = kinds.to_numpy()
            has_code = known.is_valid().to_numpy(zero_copy_only=False)
            given = known.fill_null(-1).to_numpy()
            for of in np.unique(kind):
                rows = np.flatnonzero(kind == of)
                if of != open_kind:
                    if waiting:
                        yield bitmaps(open_kind, shard, *map(np.concatenate, zip(*waiting, strict=True)))
                        waiting, n_waiting = [], 0
                    open_kind, code, following = int(of), -1, sizes.get((int(of), shard), 0)
                starts = first[rows]
                new = starts & ~has_code[rows]
                numbers = np.where(new, following + np.cumsum(new) - 1, given[rows])
                following += int(new.sum())
                at = np.cumsum(starts) - 1  # of each row, the identifier's first row; -1 goes on from the batch before
                own = np.r_[numbers[starts], code][at]
                code = int(own[-1])
                if keep and new.any():
                    n = int(new.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, of, np.int32)), pa.nulls(n, pa.int64()), pa.array(np.full(n, shard, np.int32)), pa.nulls(n, pa.int64()),
                         pa.nulls(n, pa.binary()), ids.take(pa.array(rows[new])), pa.array(numbers[new])], names,
                    )
                in_cell = cells.take(pa.array(rows))
                counted = in_cell.is_valid().to_numpy(zero_copy_only=False)
                if counted.any():
                    waiting.append((own[counted], in_cell.drop_null().to_numpy()))
                    n_waiting += int(counted.sum())
                if n_waiting > MOST_WAITING:
                    yield bitmaps(open_kind, shard, *map(np.concatenate, zip(*waiting, strict=True)))
                    waiting, n_waiting = [], 0
            last = kinds[-1].as_py(), ids[-1].as_py()
        if waiting:
            yield bitmaps(open_kind, shard, *map(np.concatenate, zip(*waiting, strict=True)))

    return encode


def distinct_bitmaps(df: DataFrame, dimensions: list[str], identifiers: dict[str, list[str]], *, dictionary: IdentifierDictionary | None = None) -> DataFrame:
    """Partial results: ``kind, <dimensions>, shard, bucket, bitmap``, written to the shared folder.

    ``identifiers`` names the kinds of identifier to count and the string columns that make one up; one with a
    null in any of them is not counted. A null dimension is a value of its own. Repeated rows change nothing,
    other columns may have any name, an empty table gives no rows.

    Identifiers are hash-partitioned into shards (after equal ones of a batch are combined, so that a hot one does not
    fill a shard), sorted, and numbered densely within their kind and shard; a bitmap has ``BUCKET`` successive codes of
    one cell of the dimensions. An identifier has the same shard, bucket and position everywhere, so OR over cells (and AND, for
    what they have in common) is exact bucket by bucket. With a kept ``dictionary`` this holds for the bitmaps of all runs that use
    it: known identifiers are shuffled with the rows and keep their codes, new ones are added. Bitmaps of runs without a
    common dictionary must not be united.
    """
    spark = df.sparkSession
    columns = list(dict.fromkeys(c for own in identifiers.values() for c in own))
    if taken := {"kind", "cell", "shard", "bucket", "bitmap", "by", "n_distinct", "n", "subset"} & set(dimensions):
        raise ValueError(f"dimensions may not be named {sorted(taken)}")
    dictionary = dictionary or IdentifierDictionary(spark, list(identifiers))
    df = spread(df.select(*dict.fromkeys([*dimensions, *columns])))
    cells = written(df.select(*dimensions).distinct().withColumn("cell", F.monotonically_increasing_id()))
    same = reduce(lambda x, y: x & y, [df[d].eqNullSafe(cells[d]) for d in dimensions])
    joined = df.join(cells, same).select("cell", *[df[c] for c in columns])  # broadcast or shuffled by the measured size of cells
    entries = F.array(*[
        F.when(
            reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in own]),
            F.struct(F.lit(dictionary.kinds.index(k)).alias("kind"), F.concat_ws("\x1f", *own).alias("id")),
        )
        for k, own in identifiers.items()
    ])
    rows = joined.select("cell", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).select("e.kind", "e.id", "cell")
    combined = rows.mapInArrow(_combined, "kind int, id string, cell bigint").withColumn("code", F.lit(None).cast("bigint"))
    sizes = dictionary.sizes()
    if sizes:
        known = dictionary.entries().where(F.col("kind").isin([dictionary.kinds.index(k) for k in identifiers]))
        combined = combined.union(known.select("kind", "id", F.lit(None).cast("bigint").alias("cell"), "code"))
    coded = written(
        combined.repartition(dictionary.shards, "kind", "id").sortWithinPartitions("kind", "id", F.col("code").desc_nulls_last())
        .mapInArrow(_encoder(sizes, dictionary.kept), "kind int, cell bigint, shard int, bucket bigint, bitmap binary, id string, code bigint")
    )
    if dictionary.kept:
        dictionary.add(coded.where("id is not null").select("kind", "shard", "id", "code"))
    names = F.array(*[F.lit(k) for k in dictionary.kinds])
    return coded.where("bitmap is not null").join(cells, "cell").select(
        F.element_at(names, F.col("kind") + 1).alias("kind"), *dimensions, "shard", "bucket", "bitmap"
    )


def ored(bitmaps: DataFrame, by: list[str]) -> DataFrame:
    """``<by>, bitmap, n``: the OR of the bitmaps of each group, and its bits.

    Bitmaps of a batch are ORed before they are shuffled; afterwards they come sorted by group, and a task holds
    ``MOST_ROWS`` of them and the open group's OR, whatever the number of groups or of their rows.
    """
    kinds = dict(bitmaps.dtypes)
    given = bitmaps.select(*by, "bitmap")

    def some(table: pa.Table, group: np.ndarray) -> pa.Table:
        first = np.unique(group, return_index=True)[1]
        merged, counts = or_groups(table["bitmap"].to_pylist(), group, len(first))
        columns = [table[c].combine_chunks().take(pa.array(first)) for c in by]
        return pa.table([*columns, pa.array(merged, pa.binary()), pa.array(counts)], names=[*by, "bitmap", "n"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, MOST_ROWS):
                table = pa.Table.from_batches([batch.slice(at, MOST_ROWS)])
                yield from some(table, _codes(table, by)).drop(["n"]).to_batches()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, MOST_ROWS):
                table = pa.Table.from_batches([batch.slice(at, MOST_ROWS)])
                if held is not None:
                    table = pa.concat_tables([held.drop(["n"]).cast(table.schema), table])
                code = _codes(table, by)
                group = np.cumsum(np.r_[False, code[1:] != code[:-1]])
                done = some(table, group)
                held = done.slice(done.num_rows - 1)
                yield from done.slice(0, done.num_rows - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    columns = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    together = given.mapInArrow(partial, f"{columns}, bitmap binary").repartition(*by).sortWithinPartitions(*by)
    return together.mapInArrow(final, f"{columns}, bitmap binary, n bigint")


def distinct_counts(bitmaps: DataFrame, dimensions: list[str]) -> DataFrame:
    """Exact distinct identifiers for every subset of the dimensions: ``kind, by, <dimensions>, n_distinct``.

    ``by`` names the dimensions of the subset (``all`` for none); the others are null. Per group and bucket the bitmaps
    of its cells are ORed and their bits counted; the counts of the buckets are added up. ``bitmaps`` may unite several runs.
    """
    subsets = [c for n in range(len(dimensions), -1, -1) for c in combinations(range(len(dimensions)), n)]
    kinds = dict(bitmaps.dtypes)
    of_subset = lambda s: [F.col(d) if i in s else F.lit(None).cast(kinds[d]) for i, d in enumerate(dimensions)]
    masked = F.array(*[F.struct(F.lit(n).alias("subset"), *[c.alias(d) for c, d in zip(of_subset(s), dimensions, strict=True)]) for n, s in enumerate(subsets)])
    rows = bitmaps.select("kind", "shard", "bucket", "bitmap", F.explode(masked).alias("e")).select("e.*", "kind", "shard", "bucket", "bitmap")
    counted = ored(rows, ["subset", *dimensions, "kind", "shard", "bucket"])
    labels = F.array(*[F.lit("+".join(dimensions[i] for i in s) or "all") for s in subsets])
    return (
        counted.groupBy("kind", "subset", *dimensions).agg(F.sum("n").alias("n_distinct"))
        .select("kind", F.element_at(labels, F.col("subset") + 1).alias("by"), *dimensions, "n_distinct")
    )


def common_counts(bitmaps: DataFrame, left: str, right: str) -> DataFrame:
    """``kind, n_common``: identifiers found both in cells that satisfy ``left`` and in cells that satisfy ``right`` (SQL predicates).

    The bitmaps of each side are ORed bucket by bucket, those of both sides ANDed. A kind without a common one has no row.
    """
    key = ["kind", "shard", "bucket"]
    a = ored(bitmaps.where(left), key).select(*key, F.col("bitmap").alias("x"))
    b = ored(bitmaps.where(right), key).select(*key, F.col("bitmap").alias("y"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            n = [int(np.bitwise_count(unpack(x) & unpack(y)).sum(dtype=np.int64)) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(n, pa.int64())], ["kind", "n"])

    return a.join(b, key).mapInArrow(both, "kind string, n bigint").groupBy("kind").agg(F.sum("n").alias("n_common")).where("n_common > 0")
