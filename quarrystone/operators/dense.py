"""Exact nearest neighbours: buckets of vectors against blocks of queries, best rows kept before anything is ranked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.session import prepare

#: Up to so many queries are broadcast; more are dealt into blocks of as many that meet buckets of vectors on the executors.
QUERY_BLOCK = 1024
VECTOR_BUCKET = 8192
#: Most distances that a task holds at once.
CELLS = 1 << 20

FOUND = "query_id bigint, vec_id bigint, distance double"
NAMES = ["query_id", "vec_id", "distance"]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_of(query_ids: np.ndarray, q: np.ndarray, vec_ids: np.ndarray, v: np.ndarray, k: int, metric: str, wanted: np.ndarray | None = None, cells: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The best ``k`` vectors of each query; ties to 9 decimals by vec_id, as in the final order.

    With ``wanted`` (queries by cells) and the ``cells`` of the vectors, a query meets those of the cells that it wants.
    """
    step = max(1, CELLS // max(1, len(v)))
    vv, norms = (v * v).sum(1), np.linalg.norm(v, axis=1)
    for at in range(0, len(q), step):
        some = q[at : at + step]
        if metric == "cosine":
            d = 1 - (some @ v.T) / np.outer(np.linalg.norm(some, axis=1), norms)
        else:
            d = (some * some).sum(1)[:, None] + vv[None, :] - 2 * (some @ v.T)
        near = np.round(d, 9)
        if wanted is not None:
            near[~wanted[at : at + step][:, cells]] = np.inf
        if k < len(v):
            rows, cols = np.nonzero(near <= np.partition(near, k - 1, axis=1)[:, k - 1 : k])  # ties at the border included
        else:
            rows, cols = np.divmod(np.arange(d.size), len(v))
        order = np.lexsort((vec_ids[cols], near[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        held = (nth < k) & (True if wanted is None else near[rows, cols] < np.inf)
        rows, cols = rows[held], cols[held]
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[at + rows]), pa.array(vec_ids[cols]), pa.array(d[rows, cols])], names=NAMES)


def _whole(table: DataFrame, dimensions: int) -> DataFrame:
    """Rows with a vector of that many numbers and no null among them."""
    return table.filter((F.size("embedding") == dimensions) & ~F.exists("embedding", lambda x: x.isNull()))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2sq") -> DataFrame:
    """(query_id, vec_id, distance, rank) of the ``k`` nearest vectors of each query; ties by vec_id, ranks from 0.

    ``l2sq`` is the squared distance, ``cosine`` one minus the cosine.  A bounded set of queries is broadcast, and each batch of
    vectors yields its own best k.  A larger one never passes the driver: its blocks meet buckets of vectors, a task each.
    Vectors without a value, with null numbers or of another length than the first query's are left out.
    """
    prepare(vectors.sparkSession)
    first = queries.filter("embedding IS NOT NULL").select(F.size("embedding")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    vectors, queries = _whole(vectors.select("vec_id", "embedding"), first[0]), _whole(queries.select("query_id", "embedding"), first[0])
    n = queries.count()
    found = _against_few(vectors, queries, k, metric) if n <= QUERY_BLOCK else _in_blocks(vectors, queries, k, metric, n)
    by = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def _against_few(vectors: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    asked = queries.toArrow()  # at most QUERY_BLOCK rows
    shared = vectors.sparkSession.sparkContext.broadcast((asked.column(0).to_numpy(), _matrix(asked.column(1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(shared.value[0]):
                yield from best_of(*shared.value, batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1)), k, metric)

    return vectors.mapInArrow(search, FOUND)


def _in_blocks(vectors: DataFrame, queries: DataFrame, k: int, metric: str, n: int) -> DataFrame:
    blocks = -(-n // QUERY_BLOCK)
    buckets = -(-max(1, vectors.count()) // VECTOR_BUCKET)
    deal = lambda c, ways: F.pmod(F.xxhash64(c), F.lit(ways)).cast("int")
    every = lambda ways: F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))
    # Renamed, since queries are often rows of the same table as the vectors.
    q = queries.select("query_id", F.col("embedding").alias("asked")).withColumn("block", deal("query_id", blocks)).withColumn("bucket", every(buckets))
    v = vectors.withColumn("bucket", deal("vec_id", buckets)).withColumn("block", every(blocks))

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and held.num_rows:
            found = list(best_of(asked.column("query_id").to_numpy(), _matrix(asked.column("asked")), held.column("vec_id").to_numpy(), _matrix(held.column("embedding")), k, metric))
        return pa.Table.from_batches(found, pa.schema(zip(NAMES, (pa.int64(), pa.int64(), pa.float64()), strict=True)))

    return q.groupBy("block", "bucket").cogroup(v.groupBy("block", "bucket")).applyInArrow(meet, FOUND)
