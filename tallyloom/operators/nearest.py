"""Exact nearest neighbours of a stated query set among all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are broadcast at once; more are searched block by block.
MOST_QUERIES = 20_000
#: Query vectors that are compared with a batch at once.
QUERY_BLOCK = 256


def nearest(vectors: DataFrame, queries: DataFrame, *, key: str, vector: str, k: int) -> DataFrame:
    """``query, neighbour, distance``: the ``k`` nearest other rows of each query by Euclidean distance, ties by key.

    Each batch of ``vectors`` is compared with ``QUERY_BLOCK`` queries at a time as a matrix product and keeps its ``k`` best for each
    query, whose distances are then taken exactly; these are merged. Rows with a null key or vector, or of another length than
    the first query, are left out. Keys have the type they have in ``vectors``.
    """
    kind, found, block, length = dict(vectors.dtypes)[key], None, [], None
    rows = lambda df: df.select(F.col(key).cast(kind).alias("key"), F.col(vector).cast("array<double>").alias("vector")).where("key is not null and vector is not null")
    given, key_type = rows(vectors), vectors.select(key).limit(0).toArrow().schema.field(0).type

    def search(names: list, values: list) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((pa.array(names, key_type), np.array(values, np.float64)))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_names, own = shared.value
            for batch in batches:
                batch = batch.take(pc.sort_indices(batch.column(0)))  # so that ties go to the smaller key
                batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), own.shape[1]))
                if not batch.num_rows:
                    continue
                other, ids = batch.column(1).flatten().to_numpy().reshape(-1, own.shape[1]), batch.column(0)
                squares = (other**2).sum(1)
                for at in range(0, len(own), QUERY_BLOCK):
                    of = own[at : at + QUERY_BLOCK]
                    about = (of**2).sum(1)[:, None] + squares - 2 * of @ other.T
                    bound = np.partition(about, k, axis=1)[:, k] if k < len(other) else about.max(1)
                    slack = 1e-9 * (1 + (of**2).sum(1) + squares.max())
                    who, which = np.nonzero(about <= (bound + slack)[:, None])
                    exact = np.sqrt(((of[who] - other[which]) ** 2).sum(1))
                    order = np.lexsort((which, exact, who))
                    who, which, exact = who[order], which[order], exact[order]
                    best = np.arange(len(who)) - np.searchsorted(who, who) <= k
                    yield pa.RecordBatch.from_arrays(
                        [own_names.take(pa.array(at + who[best])), ids.take(pa.array(which[best])), pa.array(exact[best])], ["query", "neighbour", "distance"]
                    )

        return given.mapInArrow(compare, f"query {kind}, neighbour {kind}, distance double")

    for row in rows(queries).orderBy("key").toLocalIterator():
        length = length or len(row["vector"])
        if len(row["vector"]) == length:
            block.append((row["key"], row["vector"]))
        if len(block) == MOST_QUERIES:
            part, block = search(*zip(*block, strict=True)), []
            found = part if found is None else found.union(part)
    if block:
        part = search(*zip(*block, strict=True))
        found = part if found is None else found.union(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"query {kind}, neighbour {kind}, distance double")
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return found.where("query <> neighbour").withColumn("place", place).where(F.col("place") <= k).drop("place")


def principal_components(vectors: DataFrame, *, key: str, vector: str, k: int) -> DataFrame:
    """``<key>, components``: the first ``k`` principal components of centred vectors, each in the direction in which its first coefficient is positive.

    The covariance (as many rows and columns as a vector has values) is gathered by Spark; vectors are not. Null vectors are
    left out.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    given = vectors.where(f"`{vector}` is not null").select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    model = PCA(k=k, inputCol="__v", outputCol="__pc").fit(given)
    matrix = model.pc.toArray()
    sign = np.where(matrix[0] < 0, -1.0, 1.0)
    mean = np.array(given.select(F.posexplode(vector_to_array("__v"))).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").toPandas()["m"])
    shift = mean @ matrix
    turned = F.transform(F.arrays_zip(vector_to_array("__pc").alias("v"), F.array(*map(F.lit, sign.tolist())).alias("s"), F.array(*map(F.lit, shift.tolist())).alias("m")), lambda x: (x["v"] - x["m"]) * x["s"])
    return model.transform(given).select(key, turned.alias("components"))
