"""How often every distinct term occurs and in how many records, by an external sort and a run-length scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts into which copies of one pair can be split.
SALTS = 64


def _changes(column: pa.Array, previous: pa.Scalar | None) -> np.ndarray:
    """True where a value differs from the one before; at the start, from ``previous``."""
    changed = np.ones(len(column), bool)
    if len(column) > 1:
        changed[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    changed[0] = previous is None or column[0].as_py() != previous.as_py()
    return changed


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted pairs: ``term, edge, n_occurrences, n_records`` of every run of a term.

    The first and the last pair of the partition, which may go on in the one before or after, come out by themselves with
    their record as ``edge`` and no records; all other runs are whole pairs, and have a null there.
    """
    held, n_held, is_first = None, 0, True

    def rows(term: pa.Array, edge: pa.Array, occurrences: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([term, edge, pa.array(occurrences), pa.array(records)], ["term", "edge", "n_occurrences", "n_records"])

    def one(pair: pa.RecordBatch, n: int, at_edge: bool) -> pa.RecordBatch:
        edge = pair.column(1) if at_edge else pa.nulls(1, pair.column(1).type)
        return rows(pair.column(0), edge, np.array([n]), np.array([int(not at_edge)]))

    for batch in batches:
        if not batch.num_rows:
            continue
        before = (held.column(0)[0], held.column(1)[0]) if held is not None else (None, None)
        new_pair = _changes(batch.column(0), before[0]) | _changes(batch.column(1), before[1])
        if held is not None and new_pair[0]:
            yield one(held, n_held, is_first)
            n_held, is_first = 0, False
        starts = np.flatnonzero(new_pair | (np.arange(batch.num_rows) == 0))
        n = np.diff(np.r_[starts, batch.num_rows])
        n[0] += n_held
        pairs = batch.take(pa.array(starts))
        held, n_held = pairs.slice(len(starts) - 1), int(n[-1])
        done = len(starts) - 1
        if done and is_first:
            yield one(pairs.slice(0, 1), int(n[0]), True)
            pairs, n, done, is_first = pairs.slice(1), n[1:], done - 1, False
        if done:
            term = pairs.column(0).slice(0, done)
            runs = np.flatnonzero(_changes(term, None))
            yield rows(
                term.take(pa.array(runs)), pa.nulls(len(runs), pairs.column(1).type),
                np.add.reduceat(n[:done], runs), np.diff(np.r_[runs, done]),
            )
    if held is not None:
        yield one(held, n_held, True)


def term_frequencies(df: DataFrame, term: str, record: str) -> DataFrame:
    """``term, n_occurrences, n_records`` for every distinct non-null value of ``term``.

    A row with a null term or record is not counted. Repeated rows are further occurrences in the same record;
    empty strings are terms like others; other columns may have any name; an empty table gives no rows.

    Pairs of term and record are range-partitioned by (term, record, salt) and sorted by (term, record) within the partitions, so
    that a term of any size, and even copies of one pair, are spread over them. Scanning the runs then gives the occurrences and
    distinct records of each; a pair that goes over the edge of a partition is counted once when the runs are added up by term.
    """
    pairs = df.select(F.col(term).alias("term"), F.col(record).alias("record")).where("term is not null and record is not null")
    kinds = dict(pairs.dtypes)
    salted = pairs.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("tinyint"))
    ordered = salted.repartitionByRange("term", "record", "salt").sortWithinPartitions("term", "record").select("term", "record")
    runs = ordered.mapInArrow(_run_lengths, f"term {kinds['term']}, edge {kinds['record']}, n_occurrences bigint, n_records bigint")
    met = F.when(F.col("edge").isNotNull(), 1).otherwise(F.sum("n_records"))
    once = runs.repartition("term").groupBy("term", "edge").agg(F.sum("n_occurrences").alias("n_occurrences"), met.alias("n_records"))
    return once.groupBy("term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def marked(frequencies: DataFrame, n_records: int, *, fewest: int = 3, common_share: float = 0.01) -> DataFrame:
    """Adds ``mark``: ``rare`` below ``fewest`` records, else ``common`` from ``common_share`` of all records on, else null."""
    rare = F.col("n_records") < fewest
    common = F.col("n_records") >= F.lit(common_share) * F.lit(n_records)
    return frequencies.withColumn("mark", F.when(rare, "rare").when(common, "common"))
