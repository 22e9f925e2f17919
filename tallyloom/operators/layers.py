"""Intervals in layers: how often reads touch the merged intervals of each layer, without listing the pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions are cut into slices of so many; a span is met again at the start of each slice that it reaches into.
SLICE_WIDTH = 1_048_576
#: Codes of rows that are the start or the end of a read; those of spans are made of their first and last layer.
READ_START, READ_END = -1, -2


def touches_by_layer(
    spans: DataFrame, reads: DataFrame, *, spans_on: tuple[str, str, str], reads_on: tuple[str, str, str],
    first: str, last: str, n_layers: int, slice_width: int = SLICE_WIDTH,
) -> DataFrame:
    """``entity, layer, n_hits``: pairs of a read and a continuous period of the layer that share at least one position.

    ``spans_on`` and ``reads_on`` name entity, start and end of half-open intervals. A span belongs to the layers from
    ``first`` to ``last`` (numbers from 0 to ``n_layers - 1``); the periods of a layer are its spans, merged where they overlap or
    touch. Repeated reads count again; rows with a null or with ``end <= start`` are no intervals; layers without a pair are left out.

    Neither periods nor pairs are made, and nothing is joined. A period with ``from < end`` and not ``to <= start`` is touched, so a
    layer's pairs are the read starts before the end of each period less the read ends up to its start. Intervals go to the
    slices that they reach into, are summed there by position and passed once in order, with one depth for each layer. A span
    that comes from an earlier slice is in the depth that a slice begins with; reads of earlier slices are added from one row per
    slice and layer.
    """
    at = lambda column: F.floor(F.col(column) / F.lit(slice_width))

    def intervals(df: DataFrame, on: tuple[str, str, str], code: Column) -> DataFrame:
        entity, start, end = (F.col(c) for c in on)
        named = df.select(entity.alias("entity"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), code.cast("int").alias("code"))
        return named.where("entity is not null and start is not null and end is not null and end > start")

    reached = intervals(spans, spans_on, F.col(first) * n_layers + F.col(last)).withColumn("slice", F.explode(F.sequence(at("start"), at("end"))))
    met = intervals(reads, reads_on, F.lit(READ_START)).withColumn("slice", F.explode(F.array_distinct(F.array(at("start"), at("end")))))
    sliced = reached.unionByName(met).repartition("entity", "slice")

    is_read, within = F.col("code") < 0, lambda column: at(column) == F.col("slice")
    one = F.lit(1).cast("bigint")
    begin = F.struct(F.when(within("start"), F.col("start")).when(~is_read, F.col("slice") * slice_width - 1).alias("pos"), F.col("code"), one.alias("n"))
    stop = F.struct(F.when(within("end"), F.col("end")).alias("pos"), F.when(is_read, READ_END).otherwise(F.col("code")).alias("code"), F.when(is_read, one).otherwise(-one).alias("n"))
    ends = sliced.select("entity", "slice", F.explode(F.array(begin, stop)).alias("e")).select("entity", "slice", "e.*").where("pos is not null")
    summed = ends.groupBy("entity", "slice", "pos", "code").agg(F.sum("n").alias("n")).where("n <> 0")  # within the partitions as they are
    ordered = summed.sortWithinPartitions("entity", "slice", "pos")
    kind = dict(summed.dtypes)["entity"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sweep(batches, n_layers, slice_width)

    passed = ordered.mapInArrow(sweep, f"entity {kind}, slice bigint, layer int, begun bigint, ended bigint, hits bigint, read_starts bigint, read_ends bigint")
    earlier = Window.partitionBy("entity", "layer").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name: F.coalesce(F.sum(name).over(earlier), F.lit(0))
    hits = F.col("hits") + F.col("ended") * before("read_starts") - F.col("begun") * before("read_ends")
    return passed.select("entity", "layer", hits.alias("n")).groupBy("entity", "layer").agg(F.sum("n").alias("n_hits")).where("n_hits > 0")


def _sweep(batches: Iterator[pa.RecordBatch], n_layers: int, slice_width: int) -> Iterator[pa.RecordBatch]:
    """One row for each slice and layer, of rows in order of entity, slice and position.

    ``begun, ended`` are the layer's periods that do so within the slice, ``hits`` its part of the pairs as far as the slice's own reads go.
    """
    rest: pa.Table | None = None  # rows of the last position so far, as there may be more of them
    state: _Slice | None = None  # the last slice so far
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
        if not table.num_rows:
            continue
        *_, new_place = _changes(table)
        whole = int(np.flatnonzero(new_place)[-1])
        rest = table.slice(whole)
        if whole:
            found, state = _pass(table.slice(0, whole), state, n_layers, slice_width)
            yield from found
    if rest is not None:
        found, state = _pass(rest, state, n_layers, slice_width)
        yield from found
        yield state.row(n_layers)


class _Slice:
    """What is known of a slice whose rows have been passed so far."""

    def __init__(self, entity: pa.Scalar, number: int, depth: np.ndarray, sums: np.ndarray, read_starts: int, read_ends: int) -> None:
        self.entity, self.number, self.depth, self.sums, self.read_starts, self.read_ends = entity, number, depth, sums, read_starts, read_ends

    def row(self, n_layers: int) -> pa.RecordBatch:
        entity = pa.array([self.entity.as_py()], self.entity.type)
        return _rows(entity, np.array([self.number]), self.sums[None], np.array([self.read_starts]), np.array([self.read_ends]), n_layers)


def _rows(entity: pa.Array, number: np.ndarray, sums: np.ndarray, read_starts: np.ndarray, read_ends: np.ndarray, n_layers: int) -> pa.RecordBatch:
    of = np.repeat(np.arange(len(number)), n_layers)
    layer = np.tile(np.arange(n_layers, dtype=np.int32), len(number))
    columns = [entity.take(pa.array(of)), number[of], layer, *(sums[:, i].ravel() for i in range(3)), read_starts[of], read_ends[of]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["entity", "slice", "layer", "begun", "ended", "hits", "read_starts", "read_ends"])


def _changes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slice numbers and positions of the rows, and whether a row is the first here of its slice and of its place."""
    entity = table.column("entity").combine_chunks()
    number, pos = table.column("slice").to_numpy(), table.column("pos").to_numpy()
    new_slice = np.ones(len(pos), bool)
    new_slice[1:] = pc.not_equal(entity[1:], entity[:-1]).to_numpy(zero_copy_only=False) | (number[1:] != number[:-1])
    new_place = new_slice.copy()
    new_place[1:] |= pos[1:] != pos[:-1]
    return number, pos, new_slice, new_place


def _pass(table: pa.Table, state: _Slice | None, n_layers: int, slice_width: int) -> tuple[list[pa.RecordBatch], _Slice]:
    """Slices that are complete, and the last one, after rows of whole places that follow ``state``."""
    entity = table.column("entity").combine_chunks()
    number, pos, new_slice, new_place = _changes(table)
    code, n = table.column("code").to_numpy(), table.column("n").to_numpy()
    places = np.flatnonzero(new_place)
    rows_of = np.flatnonzero(code >= 0)
    step = np.zeros((len(pos), n_layers + 1), np.int64)
    step[rows_of, code[rows_of] // n_layers] = n[rows_of]
    step[rows_of, code[rows_of] % n_layers + 1] = -n[rows_of]
    step = np.add.reduceat(step, places, axis=0).cumsum(axis=1)[:, :n_layers]
    starts = np.add.reduceat(np.where(code == READ_START, n, 0), places)
    ends = np.add.reduceat(np.where(code == READ_END, n, 0), places)

    firsts = np.flatnonzero(new_slice[places])  # of each slice, its first place
    group = np.cumsum(new_slice[places]) - 1
    follows = state is not None and state.number == number[0] and state.entity == entity[0]

    def running(values: np.ndarray, given: np.ndarray | int) -> np.ndarray:
        """Sums within the slices up to each place; the first slice begins with ``given``."""
        total = values.cumsum(axis=0)
        base = total[firsts] - values[firsts]
        if follows:
            base[0] -= given
        return total - base[group]

    depth = running(step, state.depth if follows else 0)
    read_starts, read_ends = running(starts, state.read_starts if follows else 0), running(ends, state.read_ends if follows else 0)
    inside = (pos[places] >= number[places] * slice_width)[:, None]  # not the depth that a slice begins with
    begins = (depth > 0) & (depth == step) & inside
    stops = (depth == 0) & (step < 0) & inside
    hits = stops * (read_starts - starts)[:, None] - begins * read_ends[:, None]
    sums = np.stack([np.add.reduceat(x.astype(np.int64), firsts, axis=0) for x in (begins, stops, hits)], axis=1)

    found = []
    if follows:
        sums[0] += state.sums
    elif state is not None:
        found.append(state.row(n_layers))
    lasts = np.append(firsts[1:], len(places)) - 1
    done = lasts[:-1]
    if len(done):
        found.append(_rows(entity.take(pa.array(places[done])), number[places[done]], sums[:-1], read_starts[done], read_ends[done], n_layers))
    return found, _Slice(entity[int(places[-1])], int(number[-1]), depth[-1], sums[-1], int(read_starts[-1]), int(read_ends[-1]))
