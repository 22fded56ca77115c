"""A BM25 index that follows a corpus: immutable segments, documents marked as gone, and statistics that add up.

An increment writes a segment of the added documents, a row for each document that went, and how many documents of each term went with
them; no posting of another segment is written again.  Documents, lengths and document frequencies of all segments are sums, less what went, so
scores equal those of an index built anew.  Segments of about one size are merged when there are several, and one that is mostly gone is
rewritten; a posting is so written about once for each step of size that its segment grows by.

A listing (JSON beside the version it belongs to) names the segments and tables; nothing that an older listing names is changed.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone import store
from quarrystone.config import Settings
from quarrystone.operators import bm25

#: So many segments of one step of size are merged; a step is a factor.
MERGED, STEP = 4, 4
#: Up to so many rows of documents that went are broadcast.
BROADCAST_GONE = 500_000
#: A document's place in the corpus is the number of its segment's increment times this, plus its place there.
PLACES = 1 << 40

GONE = "segment string, key string, dl bigint"
WENT = "segment string, term string, df bigint"


def empty_listing() -> dict:
    return {"made": 0, "segments": [], "gone": [], "went": []}


def read_listing(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_listing(spark: SparkSession, listing: dict, path: str) -> None:
    if not store.claim(spark, path, json.dumps(listing)):
        raise store.Conflict(f"{path} is there already")


def _tables(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def numbered(corpus: DataFrame, order: list[str], folder: str) -> DataFrame:
    """The other columns of rows with ``place``, counted from 0 in ``order``: ranges are sorted by tasks and begin where those before them end."""
    spark = corpus.sparkSession
    corpus.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).drop(*order).write.parquet(folder, compression="zstd")
    rows = spark.read.parquet(folder).withColumn("_range", F.shiftright("_at", 33))
    begins, at = [], 0
    for number, n in sorted(rows.groupBy("_range").count().collect()):  # a row a range
        begins.append((number, at))
        at += n
    if not begins:
        return rows.withColumn("place", F.lit(0).cast("bigint")).drop("_at", "_range")
    begins = F.broadcast(spark.createDataFrame(begins, "_range bigint, _begin bigint"))
    return rows.join(begins, "_range").withColumn("place", F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_range", "_begin")


def _describe(spark: SparkSession, folder: str) -> dict:
    told = bm25.bucketed(spark, f"{folder}/postings", "key").agg(*[F.coalesce(c, F.lit(0)) for c in (F.count("*"), F.sum("dl"), F.sum(F.size("terms")))]).first()
    return {"folder": folder, "docs": told[0], "length": told[1], "postings": told[2], "gone": 0}


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """(key, ord, dl) of a segment's documents; only these columns of its postings are read."""
    return bm25.bucketed(spark, f"{folder}/postings", "key").select("key", "ord", "dl")


def _write(docs: DataFrame, folder: str, buckets: int | None = None) -> dict:
    """A segment of stored rows (key, ord, dl, terms, tfs), or of rows that come dealt by key into so many buckets."""
    spark = docs.sparkSession
    stored = bm25.write_bucketed(docs.select("key", "ord", "dl", "terms", "tfs"), "key", f"{folder}/postings", buckets, "zstd")
    stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{folder}/terms", compression="zstd")
    return _describe(spark, folder)


def _segment(corpus: DataFrame, order: list[str], folder: str, made: int) -> dict:
    """A segment of (key, text) rows in ``order``.

    Only keys are put in order.  Then texts and places are dealt by key, and texts are counted where they lie, as a text is smaller than its
    counted words.  Rows that share a key lie together then; where there are such, they are made one document and stored again.
    """
    spark = corpus.sparkSession
    buckets = bm25.buckets_for(spark, (corpus.agg(F.sum(F.length("text"))).first()[0] or 0) // bm25.POSTING_CHARS)
    keyed = corpus.select("key", "text", *[F.col(c).alias(f"_by_{c}") for c in order])
    placed = numbered(keyed.drop("text"), [f"_by_{c}" for c in order], f"{folder}/rows")
    places = placed.repartition(buckets, "key").groupBy("key").agg((F.min("place") + F.lit(made * PLACES)).alias("ord"))
    texts = keyed.select("key", "text").repartition(buckets, "key")
    rows = bm25.counted(texts.join(places.hint("shuffle_hash"), "key", "left").withColumn("ord", F.coalesce("ord", F.lit(made * PLACES))), "key", "ord")
    segment = _write(rows, folder, buckets)
    stored = bm25.bucketed(spark, f"{folder}/postings", "key")
    one = bm25.one_each(stored, "key")
    if one is not stored:
        store.remove(spark, f"{folder}/terms")
        one.write.mode("overwrite").parquet(f"{folder}/rows")
        segment = _write(spark.read.parquet(f"{folder}/rows"), folder)
    store.remove(spark, f"{folder}/rows")
    return segment


def _without(rows: DataFrame, gone: DataFrame, folder: str, n: int) -> DataFrame:
    """Rows of a segment whose documents are still there."""
    mine = gone.filter(F.col("segment") == folder).select("key")
    return rows.join(F.broadcast(mine) if n <= BROADCAST_GONE else mine, "key", "left_anti") if n else rows


def increment(spark: SparkSession, root: str, listing: dict, removed: DataFrame | None, added: DataFrame, order: list[str]) -> dict:
    """The listing after documents went (``removed``: key) and came (``added``: key, text and the columns of ``order``).

    Added documents come behind all others in the corpus' order.  A key that goes and comes again is another document.
    """
    root, made = root.rstrip("/"), listing["made"] + 1
    segments, gone, went = [dict(s) for s in listing["segments"]], list(listing["gone"]), list(listing["went"])
    if removed is not None and segments:
        old = _tables(spark, gone, GONE)
        keys = removed.select(F.col("key").cast("string")).distinct()
        docs = [_without(_docs(spark, s["folder"]), old, s["folder"], s["gone"]).select(F.lit(s["folder"]).alias("segment"), "key", "dl") for s in segments]
        new = f"{root}/gone-{uuid.uuid4().hex}"
        reduce(DataFrame.unionByName, docs).join(keys, "key", "left_semi").select("segment", "key", "dl").write.parquet(new)
        told = spark.read.schema(GONE).parquet(new)
        counts = {r["segment"]: r["n"] for r in told.groupBy("segment").agg(F.count("*").alias("n")).collect()}  # a row a segment
        if counts:
            posts = [bm25.bucketed(spark, f"{folder}/postings", "key").select("key", "terms").join(told.filter(F.col("segment") == folder).select("key"), "key", "left_semi").select(F.lit(folder).alias("segment"), F.explode("terms").alias("term")) for folder in counts]
            terms = f"{root}/went-{uuid.uuid4().hex}"
            reduce(DataFrame.unionByName, posts).groupBy("segment", "term").agg(F.count("*").alias("df")).write.parquet(terms)
            gone.append(new)
            went.append(terms)
            for s in segments:
                s["gone"] += counts.get(s["folder"], 0)
        else:
            store.remove(spark, new)
    if not added.isEmpty():
        segments.append(_segment(added.withColumn("key", F.col("key").cast("string")), order, f"{root}/segment-{uuid.uuid4().hex}", made))
    return _merged(spark, root, {"made": made, "segments": segments, "gone": gone, "went": went})


def _merged(spark: SparkSession, root: str, listing: dict) -> dict:
    """The listing with segments of one step of size merged where there are ``MERGED`` of them, and those that are mostly gone rewritten."""
    while True:
        segments = [s for s in listing["segments"] if s["docs"] > s["gone"]]
        steps: dict[int, list[dict]] = {}
        for s in segments:
            steps.setdefault(int(log(max(1, s["postings"]), STEP)), []).append(s)
        chosen = next((held for _, held in sorted(steps.items()) if len(held) >= MERGED), None) or [s for s in segments if 2 * s["gone"] > s["docs"]][:1]
        if not chosen:
            return listing | {"segments": segments}
        gone = _tables(spark, listing["gone"], GONE)
        live = [_without(bm25.bucketed(spark, f"{s['folder']}/postings", "key"), gone, s["folder"], s["gone"]) for s in chosen]
        whole = _write(reduce(DataFrame.unionByName, live), f"{root}/segment-{uuid.uuid4().hex}")
        # Rows of segments that are no longer listed match nothing; the tables are written again without them when none is left of one.
        kept = [s for s in segments if s not in chosen]
        names = [s["folder"] for s in kept]
        tables = {part: [path for path in listing[part] if not _tables(spark, [path], schema).filter(F.col("segment").isin(names)).isEmpty()] for part, schema in (("gone", GONE), ("went", WENT))}
        listing = listing | tables | {"segments": [*kept, whole]}


def index(spark: SparkSession, listing: dict, settings: Settings | None = None) -> bm25.Index:
    """The index that a listing names, as any other: its segments are the parts, without the documents that went."""
    segments = listing["segments"]
    names = [s["folder"] for s in segments]
    gone = _tables(spark, listing["gone"], GONE).filter(F.col("segment").isin(names))
    parts = tuple(_without(bm25.bucketed(spark, f"{s['folder']}/postings", "key"), gone, s["folder"], s["gone"]) for s in segments)
    schema = "key string, ord bigint, dl bigint"
    docs = reduce(DataFrame.unionByName, [_without(_docs(spark, s["folder"]), gone, s["folder"], s["gone"]) for s in segments]) if segments else spark.createDataFrame([], schema)
    lengths = gone.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("less"))
    n, length = sum(s["docs"] - s["gone"] for s in segments), sum(s["length"] for s in segments)
    size = lengths.select(F.lit(n).cast("bigint").alias("n_docs"), ((F.lit(length) - F.col("less")) / F.lit(max(1, n))).alias("avgdl"))
    counts = _tables(spark, [f"{name}/terms" for name in names], "term string, df bigint")
    went = _tables(spark, listing["went"], WENT).filter(F.col("segment").isin(names)).select("term", (-F.col("df")).alias("df"))
    counts = counts.unionByName(went).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    if not parts:
        parts = (spark.createDataFrame([], "key string, ord bigint, dl bigint, terms array<string>, tfs array<int>"),)
    return bm25.Index(parts, bm25.with_idf(counts, size, settings), size, docs, "key")
