"""File manifests and incremental index maintenance, as joins of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_manifest(files: DataFrame, chunks: DataFrame, settings_hash: str = "") -> DataFrame:
    """One row a file: signature, title and its chunk ids in order.

    Files that gave no chunks are listed too (with none), so that the next run does not take them for new, and the settings
    that made the chunks are part of the signature.
    """
    ids = chunks.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda c: c["chunk_id"]).alias("chunk_ids"))
    listed = files.join(ids, "path", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))
    return listed.withColumn("settings_hash", F.lit(settings_hash))


def diff_manifest(old: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status): changed, deleted, unchanged or new, by size, time and digest."""
    o = old.select("path", F.struct("size_bytes", "mtime", "sha256").alias("was"))
    n = files.select("path", F.struct("size_bytes", "mtime", "sha256").alias("now"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return o.join(n, "path", "full_outer").select("path", status.alias("status"))


def stale_chunks(old_chunks: DataFrame, diff: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Ids to delete: all of deleted files, and of changed files those that the new version no longer has."""
    touched = old_chunks.join(diff.filter(F.col("status").isin("deleted", "changed")).select("path"), "path", "left_semi").select("chunk_id")
    return touched.join(new_chunks.select("chunk_id"), "chunk_id", "left_anti").distinct()


def apply_increment(old_chunks: DataFrame, diff: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """The corpus after an increment: chunks of untouched files, then those of changed and new files."""
    kept = old_chunks.join(diff.filter(F.col("status").isin("deleted", "changed")).select("path"), "path", "left_anti")
    added = new_chunks.join(diff.filter(F.col("status").isin("changed", "new")).select("path"), "path", "left_semi")
    return kept.withColumn("origin", F.lit("kept")).unionByName(added.withColumn("origin", F.lit("added")))


def merge_manifest(old: DataFrame, diff: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Old entries of untouched files and rebuilt ones of changed and new files."""
    kept = old.join(diff.filter("status = 'unchanged'").select("path"), "path", "left_semi")
    return kept.unionByName(rebuilt.join(diff.filter(F.col("status").isin("changed", "new")).select("path"), "path", "left_semi"))


def full_rebuild_reason(enabled: bool, manifest_rows: int, same_collection: bool, corpus_exists: bool, same_settings: bool) -> str | None:
    """Why an increment is impossible; null if it isn't."""
    for wrong, reason in ((not enabled, "disabled"), (not manifest_rows, "manifest_missing"), (not same_collection, "collection_mismatch"), (not corpus_exists, "corpus_missing"), (not same_settings, "settings_changed")):
        if wrong:
            return reason
    return None
