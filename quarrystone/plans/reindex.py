"""Reindexing as one operation: what changed is chunked, embedded and indexed, the rest is carried over, and a whole version is published."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone import store
from quarrystone.config import Settings
from quarrystone.functions.models import Embedder, embed
from quarrystone.operators import bm25, segments
from quarrystone.operators import manifest as M
from quarrystone.plans.answering import build_index

Progress = Callable[[str, float], None]
#: Up to so many paths of changed files are broadcast, so that texts and chunks stay where they are.
BROADCAST_PATHS = 1_000_000


@dataclass(frozen=True)
class Outcome:
    """The version that is current now, why it was built in full (none: it was an increment), and how many files there were of each kind."""

    version: str
    full_reason: str | None
    counts: dict[str, int]


class NothingExtracted(RuntimeError):
    """Changed files gave no chunks at all; the active version is left as it is."""


def reindex(
    spark: SparkSession, root: str, files: DataFrame, chunk: Callable[[DataFrame], DataFrame], embedder: Embedder, settings_hash: str = "", incremental: bool = True, progress: Progress = lambda stage, share: None, body: tuple[str, ...] = ()
) -> Outcome:
    """Bring the index below ``root`` up to the snapshot ``files`` (path, size_bytes, mtime, sha256, ...).

    ``chunk`` makes (path, chunk_index, chunk_id, text) of files; columns that only it reads, ``body``, are in no manifest.  A full build is made if increments are switched off, if there is
    no version, manifest or corpus yet, or if the settings have changed.  Nothing of the active version is ever written; a crash at any point
    leaves it current, and the next run starts anew.  ``progress`` hears each stage and the share done.

    A version's BM25 index follows by segments: an increment writes postings of its own chunks only (``sparse_index`` reads them).  A run whose
    start was overtaken by another's publication ends in ``store.Conflict`` and changes nothing.
    """
    started = store.last(spark, root)
    active = store.current(spark, root)
    parts = [active and store.exists(spark, f"{active}/{part}") for part in ("manifest/_SUCCESS", "chunks/_SUCCESS", "vectors/_SUCCESS", "listing")]
    old = spark.read.parquet(f"{active}/manifest") if parts[0] else None
    same = old is not None and old.filter(F.col("settings_hash") != settings_hash).isEmpty()
    rows = 0 if old is None else old.limit(1).count()
    reason = M.full_rebuild_reason(incremental, rows, bool(parts[2]), bool(parts[1] and parts[3]), same)
    progress("compared", 0.1)
    if reason:
        version = build_index(spark, root, files.drop(*body), chunk(files), embedder, settings_hash)
        if files.limit(1).count() and spark.read.parquet(f"{version}/chunks").isEmpty():
            raise NothingExtracted(f"no chunks from any file; {active or 'nothing'} stays current")
        listed = segments.increment(spark, f"{root.rstrip('/')}/segments", segments.empty_listing(), None, _keyed(spark.read.parquet(f"{version}/chunks")), ORDER)
        segments.write_listing(spark, listed, f"{version}/listing")
        progress("built", 0.9)
        store.publish(spark, root, version, after=started)
        progress("published", 1.0)
        return Outcome(version, reason, {"new": files.count()})

    version = f"{root.rstrip('/')}/version-{uuid.uuid4().hex}"
    M.diff_manifest(old, files).write.parquet(f"{version}/diff")
    diff = spark.read.parquet(f"{version}/diff")
    counts = {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}  # four kinds
    if not set(counts) - {"unchanged"}:
        progress("unchanged", 1.0)
        return Outcome(active, None, counts)

    def paths(*kinds: str) -> DataFrame:
        some = diff.filter(F.col("status").isin(*kinds)).select("path")
        return F.broadcast(some) if sum(counts.get(kind, 0) for kind in kinds) <= BROADCAST_PATHS else some

    work = files.join(paths("changed", "new"), "path", "left_semi")
    chunk(work).write.parquet(f"{version}/added", compression="zstd")
    added = spark.read.parquet(f"{version}/added")
    if counts.get("changed", 0) + counts.get("new", 0) and added.isEmpty():
        raise NothingExtracted(f"no chunks from {counts}; {active} stays current")
    progress("chunked", 0.3)
    old_chunks = spark.read.parquet(f"{active}/chunks")
    kept = old_chunks.join(paths("changed", "deleted"), "path", "left_anti")
    kept.unionByName(added).select(*old_chunks.columns).write.parquet(f"{version}/chunks", compression="zstd")
    went = old_chunks.join(paths("changed", "deleted"), "path", "left_semi").select("chunk_id")
    few = went.limit(segments.BROADCAST_GONE + 1).count() <= segments.BROADCAST_GONE
    vectors = spark.read.parquet(f"{active}/vectors").join(F.broadcast(went) if few else went, "chunk_id", "left_anti")
    fresh = embed(added.withColumnRenamed("chunk_id", "key"), embedder).withColumnRenamed("key", "chunk_id")
    vectors.unionByName(fresh).write.parquet(f"{version}/vectors", compression="zstd")
    progress("embedded", 0.7)
    listed = segments.increment(spark, f"{root.rstrip('/')}/segments", segments.read_listing(spark, f"{active}/listing"), went.withColumnRenamed("chunk_id", "key"), _keyed(added), ORDER)
    segments.write_listing(spark, listed, f"{version}/listing")
    progress("indexed", 0.8)
    rebuilt = M.build_manifest(work.select(*[c for c in old.columns if c not in ("chunk_ids", "settings_hash")]), added, settings_hash)
    M.merge_manifest(old, diff, rebuilt).write.parquet(f"{version}/manifest", compression="zstd")
    n_chunks, n_vectors = (spark.read.parquet(f"{version}/{part}").count() for part in ("chunks", "vectors"))
    if n_chunks != n_vectors:
        raise RuntimeError(f"{n_vectors} vectors for {n_chunks} chunks: the version is not published")
    store.remove(spark, f"{version}/added")  # its rows are among the chunks
    store.publish(spark, root, version, after=started)
    progress("published", 1.0)
    return Outcome(version, None, counts)


#: The corpus' order within an increment.
ORDER = ["path", "chunk_index"]


def _keyed(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("chunk_id").alias("key"), "text", *ORDER)


def sparse_index(spark: SparkSession, version: str, settings: Settings | None = None) -> bm25.Index:
    """The BM25 index of a version's chunks (key: chunk_id)."""
    return segments.index(spark, segments.read_listing(spark, f"{version}/listing"), settings)


def exclusive_reindex(spark: SparkSession, root: str, owner: str, *args, seconds: float = 3600, progress: Progress = lambda stage, share: None, **options) -> Outcome:
    """``reindex`` as the one active job below ``root``: ``store.Busy`` if another holds the lease.

    Each stage renews the lease, so a job that was held up beyond its time and was replaced ends at its next stage, before it publishes.
    """
    lease = store.Lease.acquire(spark, root, owner, seconds)

    def told(stage: str, share: float) -> None:
        nonlocal lease
        progress(stage, share)
        lease = lease.renewed(spark, seconds)

    try:
        return reindex(spark, root, *args, progress=told, **options)
    finally:
        lease.release(spark)
