"""Exact nearest neighbours that read only what can hold one: vectors stored in cells around pivots, searched in two rounds.

A cell is a ring around a pivot: the vectors whose nearest pivot it is, at a distance between ``low`` and ``high``.  By the triangle inequality a
vector of the cell is at least ``max(d - high, low - d)`` from a query that is ``d`` from the pivot.  The first round searches the cells of
least bound that hold k vectors; the k-th distance found there is a limit, and the second round searches all other cells whose
bound doesn't pass it.  So nothing is lost, whatever the vectors look like; how much is saved depends on how they cluster.

Cosine is the same on unit vectors, where it is half the squared distance.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone import store
from quarrystone.operators.dense import FOUND, NAMES, QUERY_BLOCK, VECTOR_BUCKET, _matrix, _whole, best_of
from quarrystone.session import checkpoint_dir, prepare, shared_dir

#: At most so many pivots, with so many rings each: what the driver and every task hold of an index.
MOST_PIVOTS, RINGS = 1024, 4
#: A block that meets parts of the index has about so many times QUERY_BLOCK queries, a part about so many times VECTOR_BUCKET vectors.
MEET_BLOCKS, MEET_BUCKETS = 4, 4
#: What rounding may add to a bound.
SLACK = 1e-6


def _placed(v: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as the triangle inequality holds for them; a vector of zeros has no direction and stays."""
    if metric != "cosine":
        return v
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norms == 0, 1, norms)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


@dataclass(frozen=True)
class Cells:
    """vectors (vec_id, embedding, cell, split), cells (cell, low, high, n, splits) and pivots (pivot, center), for one metric."""

    vectors: DataFrame
    cells: DataFrame
    pivots: DataFrame
    metric: str

    @staticmethod
    def read(spark: SparkSession, folder: str, metric: str) -> Cells:
        return Cells(*(spark.read.parquet(f"{folder}/{part}") for part in ("vectors", "cells", "pivots")), metric)


def write_cells(vectors: DataFrame, folder: str, metric: str = "l2sq", pivots: int | None = None) -> Cells:
    """Deal all vectors (vec_id, embedding) of the first one's length into cells; those without a value or with null numbers are left out.

    Pivots are vectors chosen by a hash of their ids, about as many as the root of all.  A cell of many equal vectors is split by id, so that no
    task gets a hot one whole.
    """
    spark = vectors.sparkSession
    prepare(spark)
    first = vectors.filter("embedding IS NOT NULL").select(F.size("embedding")).first()
    vectors = _whole(vectors.select("vec_id", "embedding"), first[0] if first else 0)
    wanted = pivots or min(MOST_PIVOTS, max(1, math.isqrt(vectors.count())))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).toArrow()  # at most MOST_PIVOTS rows
    centers = _placed(_matrix(chosen.column(1)), metric) if chosen.num_rows else np.zeros((0, first[0] if first else 0))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "pivot int, center array<double>").write.mode("overwrite").parquet(f"{folder}/pivots")
    shared = spark.sparkContext.broadcast(centers)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _apart(_placed(_matrix(batch.column(1)), metric), shared.value)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near])], names=["vec_id", "embedding", "pivot", "away"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    vectors.mapInArrow(deal, f"{kinds}, pivot int, away double").write.mode("overwrite").parquet(f"{folder}/dealt")
    dealt = spark.read.parquet(f"{folder}/dealt")
    edges = dealt.groupBy("pivot").agg(F.percentile_approx("away", [i / RINGS for i in range(1, RINGS)], 1000).alias("edges"))
    ring = F.aggregate("edges", F.lit(0), lambda n, edge: n + F.when(F.col("away") > edge, 1).otherwise(0))
    ringed = dealt.join(F.broadcast(edges), "pivot").withColumn("cell", F.col("pivot") * RINGS + ring)  # a row a pivot
    told = ringed.groupBy("cell").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("n"))
    told.withColumn("splits", F.ceil(F.col("n") / VECTOR_BUCKET).cast("int")).write.mode("overwrite").parquet(f"{folder}/cells")
    split = F.pmod(F.xxhash64("vec_id"), F.col("splits")).cast("int")
    rows = ringed.join(F.broadcast(spark.read.parquet(f"{folder}/cells").select("cell", "splits")), "cell").withColumn("split", split)  # at most RINGS rows a pivot
    rows.select("vec_id", "embedding", "cell", "split").repartitionByRange("cell", "split").sortWithinPartitions("cell", "split").write.mode("overwrite").parquet(f"{folder}/vectors")
    return Cells.read(spark, folder, metric)


def stored_cells(vectors: DataFrame, version: str, metric: str = "l2sq", root: str | None = None) -> Cells:
    """The cells of this version of the vectors (``bm25.corpus_version`` names one): read if they are complete, else made and published."""
    spark = vectors.sparkSession
    pointer = f"{root or shared_dir(spark) + '/cells'}/{version}-{metric}"
    folder = store.current(spark, pointer)
    if folder is None:
        mine = f"{pointer}/build-{uuid.uuid4().hex}"
        write_cells(vectors, mine, metric)
        try:
            store.publish(spark, pointer, mine, after=0)
        except store.Conflict:  # another session's are as good
            store.remove(spark, mine)
        folder = store.current(spark, pointer)
    return Cells.read(spark, folder, metric)


class Bounds:
    """The pivots and cells of an index in memory, and which cells a query needs."""

    def __init__(self, index: Cells):
        rows = index.cells.orderBy("cell").collect()  # at most RINGS * MOST_PIVOTS rows
        centers = index.pivots.orderBy("pivot").collect()
        self.metric = index.metric
        self.cell, self.n = np.array([r["cell"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
        self.part = (np.cumsum(self.n) - self.n) // (MEET_BUCKETS * VECTOR_BUCKET)  # cells one after the other fill a part
        self.splits = {r["cell"]: r["splits"] for r in rows}
        self.low, self.high = (np.array([r[c] for r in rows], np.float64) for c in ("low", "high"))
        self.centers = np.array([r["center"] for r in centers], np.float64)

    def least(self, q: np.ndarray) -> np.ndarray:
        """The least distance of any vector of each cell from each query."""
        d = _apart(_placed(q, self.metric), self.centers)[:, self.cell // RINGS]
        return np.maximum(np.maximum(d - self.high, self.low - d), 0) - SLACK

    def first(self, q: np.ndarray, k: int) -> np.ndarray:
        """The cells of each query's first round, as a table of truth values: those of least bound that hold ``k`` vectors."""
        bound = self.least(q)
        order = np.argsort(bound, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        wanted = np.zeros(bound.shape, bool)
        np.put_along_axis(wanted, order, before < k, axis=1)
        return wanted

    def second(self, q: np.ndarray, k: int, limit: np.ndarray) -> np.ndarray:
        """The cells of the second round: all others whose bound doesn't pass the k-th distance (infinite if fewer were found)."""
        apart = np.sqrt(np.maximum(2 * limit if self.metric == "cosine" else limit, 0)) + SLACK
        return (self.least(q) <= apart[:, None]) & ~self.first(q, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def _search_few(index: Cells, bounds: Bounds, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int) -> DataFrame:
    """Vectors of the wanted cells against the queries that want them; the queries are broadcast."""
    place = {cell: i for i, cell in enumerate(bounds.cell.tolist())}
    shared = index.vectors.sparkSession.sparkContext.broadcast((ids, q, wanted, place))
    metric = bounds.metric

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, wanted, place = shared.value
        for batch in batches:
            cells = batch.column(2).to_numpy()
            for cell in np.unique(cells):
                some = np.flatnonzero(wanted[:, place[cell]])
                rows = pa.array(np.flatnonzero(cells == cell))
                yield from best_of(ids[some], q[some], batch.column(0).take(rows).to_numpy(zero_copy_only=False), _matrix(batch.column(1).take(rows)), k, metric)

    needed = bounds.cell[wanted.any(0)].tolist()
    rows = index.vectors.filter(F.col("cell").isin(needed)) if needed else index.vectors.limit(0)
    return rows.select("vec_id", "embedding", "cell").mapInArrow(search, FOUND)


def _search_blocks(index: Cells, asked: DataFrame, bounds: Bounds, k: int) -> DataFrame:
    """Queries (query_id, asked, block, part, split, wanted) against the parts of the index that they want: a task for each block and part that
    meet.  A query comes once to a part, with the list of its cells that it wants, and gets its best there."""
    metric = index.metric
    meets = asked.select(F.col("block").alias("to_block"), F.col("part").alias("to_part"), F.col("split").alias("to_split")).distinct()
    parts = index.vectors.sparkSession.createDataFrame(list(zip(bounds.cell.tolist(), bounds.part.tolist(), strict=True)), "of int, part int")
    held = index.vectors.join(F.broadcast(parts), F.col("cell") == F.col("of")).drop("of")  # a row a cell
    held = held.join(meets, (F.col("part") == F.col("to_part")) & (F.col("split") == F.col("to_split"))).drop("part", "split")

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and held.num_rows:
            names, cells = np.unique(held.column("cell").to_numpy(), return_inverse=True)
            lists = asked.column("wanted").combine_chunks()
            wanted = np.zeros((asked.num_rows, len(names)), bool)
            rows, cols = np.repeat(np.arange(asked.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(names, cols), len(names) - 1)
            there = names[at] == cols  # a cell may have no vector in this split
            wanted[rows[there], at[there]] = True
            found = list(best_of(asked.column("query_id").to_numpy(), _matrix(asked.column("asked")), held.column("vec_id").to_numpy(), _matrix(held.column("embedding")), k, metric, wanted, cells))
        return pa.Table.from_batches(found, pa.schema(zip(NAMES, (pa.int64(), pa.int64(), pa.float64()), strict=True)))

    return asked.groupBy("block", "part", "split").cogroup(held.groupBy("to_block", "to_part", "to_split")).applyInArrow(meet, FOUND)


def _wanting(queries: DataFrame, bounds: Bounds, k: int) -> DataFrame:
    """Queries with their home (the nearest pivot) and the cells of their next round, a row for each part of the index that holds any; ``limit``
    is null before the first."""
    shared = queries.sparkSession.sparkContext.broadcast(bounds)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        splits = np.array([b.splits[c] for c in b.cell.tolist()])
        for batch in batches:
            if batch.num_rows:
                q, limit = _matrix(batch.column(1)), batch.column(2)
                if limit.null_count:
                    wanted = b.first(q, k)
                else:
                    wanted = b.second(q, k, limit.to_numpy(zero_copy_only=False))
                home = _apart(_placed(q, b.metric), b.centers).argmin(1)
                rows, parts, at, lists = [], [], [], []
                for i, row in enumerate(wanted):
                    for part in np.unique(b.part[row]).tolist():
                        mine = row & (b.part == part)
                        for split in range(splits[mine].max()):
                            rows.append(i)
                            parts.append(part)
                            at.append(split)
                            lists.append(b.cell[mine & (splits > split)].tolist())
                rows = pa.array(rows, pa.int64())
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(home, pa.int32()).take(rows), pa.array(parts, pa.int32()), pa.array(at, pa.int32()), pa.array(lists, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "asked", "home", "part", "split", "wanted"])

    kinds = dict((f.name, f.dataType.simpleString()) for f in queries.schema)
    return queries.select("query_id", "asked", "limit").mapInArrow(tell, f"query_id {kinds['query_id']}, asked {kinds['asked']}, home int, part int, split int, wanted array<int>")


def _dealt(wanting: DataFrame) -> DataFrame:
    """Queries in blocks of about MEET_BLOCKS times QUERY_BLOCK: homes one after the other fill a block, and a home with more has several."""
    most, at, begins = MEET_BLOCKS * QUERY_BLOCK, 0, []
    for home, n in sorted(wanting.groupBy("home").agg(F.count_distinct("query_id")).collect()):  # a row a pivot
        begins.append((home, at // most, -(-n // most)))
        at += n
    homes = wanting.sparkSession.createDataFrame(begins, "home int, base int, ways int")
    block = F.when(F.col("ways") > 1, F.concat_ws("-", "base", "home", F.pmod(F.xxhash64("query_id"), F.col("ways")))).otherwise(F.col("base").cast("string"))
    return wanting.join(F.broadcast(homes), "home").withColumn("block", block).drop("base", "ways")


def nearest_in_cells(index: Cells, queries: DataFrame, k: int) -> tuple[DataFrame, dict[str, int]]:
    """(query_id, vec_id, distance, rank) as ``dense.nearest`` gives them, and how many of all pairs of a query and a cell were searched.

    A bounded set of queries is broadcast; of a larger one, blocks of queries that share a nearest pivot meet parts of cells, a task each, and
    nothing passes the driver but the index's pivots and cells.
    """
    spark = index.vectors.sparkSession
    prepare(spark)
    bounds = Bounds(index)
    dimensions = bounds.centers.shape[1] if bounds.centers.size else 0
    queries = _whole(queries.select("query_id", "embedding"), dimensions) if dimensions else queries.select("query_id", "embedding").limit(0)
    n = queries.limit(QUERY_BLOCK + 1).count()
    empty = spark.createDataFrame([], f"{FOUND}, rank int")
    if not n or not len(bounds.cell):
        return empty, {"searched": 0, "all": 0}
    checkpoint_dir(spark)
    if n <= QUERY_BLOCK:
        told = queries.toArrow()
        ids, q = told.column(0).to_numpy(), _matrix(told.column(1))
        first = bounds.first(q, k)
        found = _ranked(_search_few(index, bounds, ids, q, first, k), k).checkpoint()
        limits = dict(found.filter(F.col("rank") == k - 1).select("query_id", "distance").collect())  # a row a query
        second = bounds.second(q, k, np.array([limits.get(i, math.inf) for i in ids.tolist()]))
        more = _search_few(index, bounds, ids, q, second, k)
        return _ranked(found.drop("rank").unionByName(more), k), {"searched": int(first.sum() + second.sum()), "all": first.size}
    asked = queries.select("query_id", F.col("embedding").alias("asked"))
    n_asked = asked.count()
    started = _wanting(asked.withColumn("limit", F.lit(None).cast("double")), bounds, k).checkpoint()
    found = _ranked(_search_blocks(index, _dealt(started), bounds, k), k).checkpoint()
    limits = found.filter(F.col("rank") == k - 1).select("query_id", F.col("distance").alias("limit"))
    limited = asked.join(limits, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(math.inf)))
    wanting = _wanting(limited, bounds, k).checkpoint()
    more = _search_blocks(index, _dealt(wanting), bounds, k)
    pairs = started.unionByName(wanting).filter("split = 0").agg(F.sum(F.size("wanted"))).first()[0]
    return _ranked(found.drop("rank").unionByName(more), k), {"searched": pairs, "all": n_asked * len(bounds.cell)}
