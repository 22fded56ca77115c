"""Registered queries of what is kept and maintained: segmented indexes, event logs, stores by id, exports, embeddings, structure of Word files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from quarrystone.functions import embedding_store, models
from quarrystone.functions.docx import docx_blocks, docx_package
from quarrystone.functions.text import strip
from quarrystone.operators import bm25, lookup
from quarrystone.operators.quality_reports import document_listings
from quarrystone.operators.quality_reports import line_changes as changes
from quarrystone.plans.index_queries import BOTH_CHUNKS, DIFF, LINKS
from quarrystone.plans.inputs import BASE, NEW_FILES, OLD_FILES, TEXTS, line_chunks, line_chunks_sql, new_files, old_files
from quarrystone.plans.registry import query, table
from quarrystone.plans.reindex import reindex, sparse_index
from quarrystone.plans.retrieval_queries import bm25_sql, questions
from quarrystone.session import prepare
from quarrystone.sources import event_log, export, pages
from quarrystone.streaming import streams
from quarrystone.streaming.streams import work_folder


@query(f"""WITH {DIFF}, {BOTH_CHUNKS}, corpus AS (SELECT chunk_id, text, 0 AS part, path, chunk_index FROM old_chunks JOIN diff USING (path) WHERE status = 'unchanged'
  UNION ALL SELECT chunk_id, text, 1, path, chunk_index FROM new_chunks JOIN diff USING (path) WHERE status IN ('changed', 'new')), {bm25_sql('corpus', 'chunk_id')}
SELECT query_id, chunk_id, round(score, 6) AS score, rank - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, part, path, chunk_index) AS rank FROM scores JOIN corpus USING (chunk_id)) WHERE rank <= 10""")
def bm25_incremental(spark, sf_dir):
    """Rankings from an index that was built over the old snapshot and followed a reindex to the new one."""
    root = work_folder(spark, "segments")
    keep = ["path", "title", "size_bytes", "mtime", "sha256", "text"]
    for files in (old_files(spark, sf_dir), new_files(spark, sf_dir)):
        done = reindex(spark, root, files.select(*keep), line_chunks, models.HashEmbedder(), body=("text",))
    found = bm25.search(sparse_index(spark, done.version), questions(spark, sf_dir), 10, zero_fill=False)
    return found.select("query_id", F.col("key").alias("chunk_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("""WITH log AS (SELECT row_number() OVER (ORDER BY event_id % 2, event_id) - 1 AS nth, * FROM events)
SELECT event_type, count(*) FILTER (WHERE event_type <> 'error') AS accepted, count(*) FILTER (WHERE event_type = 'error') AS dead, min(nth) AS first, max(nth) AS last, sum(nth * (event_id % 1000 + 1))::BIGINT AS places FROM log GROUP BY event_type""")
def event_source(spark, sf_dir):
    """Events with even ids are appended to a log and read, then those with odd ids; the restarted stream goes on behind its last offset."""
    folder = work_folder(spark, "event-log")
    events = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "user_id")).alias("body"))
    parse = lambda batch: batch.select("offset", F.from_json("body", "event_id bigint, event_type string, user_id bigint").alias("e")).select("offset", "e.*")
    for rest in (0, 1):
        event_log.append_events(events.filter(F.col("event_id") % 2 == rest), f"{folder}/log", "event_id")
        streams.take_events(event_log.event_stream(spark, f"{folder}/log"), folder, F.col("event_type") == "error", parse)
    rows = spark.read.parquet(f"{folder}/accepted").withColumn("dead", F.lit(0)).unionByName(spark.read.parquet(f"{folder}/dead").withColumn("dead", F.lit(1)))
    place = F.col("offset") * (F.col("event_id") % 1000 + 1)
    return rows.groupBy("event_type").agg(F.count_if(F.col("dead") == 0).alias("accepted"), F.count_if(F.col("dead") == 1).alias("dead"), F.min("offset").alias("first"), F.max("offset").alias("last"), F.sum(place).alias("places"))


@query(f"""WITH {TEXTS}, {OLD_FILES}, {line_chunks_sql('c', 'old_files')}, asked AS (SELECT md5(path || '_0') AS chunk_id, doc_id AS position FROM texts WHERE doc_id % 20 = 0 UNION ALL SELECT md5('no such file ' || doc_id), -doc_id FROM texts WHERE doc_id % 20 = 1)
SELECT position, chunk_id, path, md5(text) AS digest FROM asked JOIN c USING (chunk_id)""")
def chunk_lookup(spark, sf_dir):
    """Chunks by id from a store of all: the first chunk of every twentieth file, and as many ids that are nowhere."""
    folder = work_folder(spark, "store")
    lookup.write_store(line_chunks(old_files(spark, sf_dir)).select("chunk_id", "path", "text"), folder, "chunk_id", 16)
    paths = old_files(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")), "path")
    there = paths.filter("doc_id % 20 = 0").select(F.md5(F.concat("path", F.lit("_0"))).alias("chunk_id"), F.col("doc_id").alias("position"))
    nowhere = paths.filter("doc_id % 20 = 1").select(F.md5(F.concat(F.lit("no such file "), F.col("doc_id").cast("string"))).alias("chunk_id"), (-F.col("doc_id")).alias("position"))
    return lookup.by_ids(spark, folder, there.unionByName(nowhere)).select("position", "chunk_id", "path", F.md5("text").alias("digest")).orderBy("position")


@query("""WITH p AS (SELECT doc_id, coalesce(text, '') AS content, lang || '/' || source || '/part ' || (doc_id % 97) || '.txt' AS path FROM documents), f AS (SELECT path, min(doc_id) AS first FROM p GROUP BY path)
SELECT CASE WHEN doc_id = first THEN path ELSE regexp_replace(path, '\\.[^./]*$', '') || '-' || substr(sha1(path || ' ' || doc_id), 1, 16) || '.txt' END AS path, strlen(content) AS bytes, sha256(content) AS sha256 FROM p JOIN f USING (path)""")
def export_manifest(spark, sf_dir):
    """All documents as files, many of which want the same path, and the manifest of what was committed."""
    root = work_folder(spark, "export")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"), F.concat("lang", F.lit("/"), "source", F.lit("/part "), (F.col("doc_id") % 97).cast("string"), F.lit(".txt")).alias("path"))
    export.export(export.unique_paths(rows.withColumn("wanted", F.col("path")), "path", "doc_id", "wanted"), root)
    return export.manifest(spark, root).select("path", "bytes", "sha256")


@query("""WITH t AS (SELECT sha256('hash:' || text) AS key, max((doc_id % 2 = 0)::INT) AS one, max((doc_id % 3 = 0)::INT) AS two, max((doc_id % 5 = 0)::INT) AS three FROM documents WHERE text IS NOT NULL GROUP BY text),
e AS (SELECT key, CASE WHEN one = 1 AND three = 0 THEN 1000 WHEN one = 0 AND two = 1 THEN 2000 WHEN three = 1 THEN 4700 END AS created, CASE WHEN three = 1 THEN 4700 WHEN two = 1 THEN 2000 ELSE 1000 END AS used FROM t WHERE one + two + three > 0)
SELECT key, created, used FROM e WHERE created > 4700 - 3600 ORDER BY used DESC, key LIMIT 250""")
def embedding_cache_runs(spark, sf_dir):
    """Three runs over overlapping texts: the entries of the first have outlived their time by the third, and 250 of the rest have room."""
    root = work_folder(spark, "embeddings")
    docs = table(spark, sf_dir, "documents")
    for now, step in ((1000, 2), (2000, 3), (4700, 5)):
        embedding_store.embedded(spark, root, docs.filter(F.col("doc_id") % step == 0), models.HashEmbedder(), "hash", now, 3600, 250 if step == 5 else 1 << 40)
    return embedding_store.entries(spark, root, 4700, 3600).select("key", "created", "used")


#: Every eighth sentence is a first heading, by a style that is based on one; the fourth after it is a second.
SPACES = r"'[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"
SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]', '', 'g'), '[.!?\n\r\t]+'), lambda x: regexp_replace(x, '^' || SPACES || '|' || SPACES || '$', '', 'g')), lambda x: x <> '')".replace("SPACES", SPACES)


@query(rf"""WITH s AS (SELECT doc_id, unnest(l) AS told, generate_subscripts(l, 1) - 1 AS block FROM (SELECT doc_id, {SENTENCES} AS l FROM documents)),
h AS (SELECT *, CASE WHEN block % 8 = 0 THEN 1 WHEN block % 8 = 4 THEN 2 END AS level FROM s),
u AS (SELECT doc_id, block, told, level, last_value(CASE WHEN level = 1 THEN told END IGNORE NULLS) OVER w AS one, last_value(CASE WHEN level IS NOT NULL THEN CASE WHEN level = 2 THEN ' → ' || told ELSE '' END END IGNORE NULLS) OVER w AS two FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, block, CASE WHEN level IS NULL THEN 'text' ELSE 'heading' END AS kind, md5(told) AS told, md5(one || two) AS section FROM u""")
def docx_structure(spark, sf_dir):
    """Documents made into Word packages and read back by their structure."""
    prepare(spark, 64)
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    told = F.filter(F.transform(F.split(clean, r"[.!?\n\r\t]+"), strip), lambda x: x != "")
    styles = [("Own", "Own head", "Base"), ("Base", "heading 1", ""), ("Heading2", "Heading 2", "")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packages = [docx_package([({0: "Own", 4: "Heading2"}.get(i % 8, "Normal"), x) for i, x in enumerate(told)], styles) for told in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packages, pa.binary())], names=["doc_id", "content"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, i, kind, text, section) for doc_id, content in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, (text, section, kind, _) in enumerate(docx_blocks(content))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["doc_id", "block", "kind", "told", "section"])

    packages = table(spark, sf_dir, "documents").select("doc_id", told.alias("told")).mapInArrow(made, "doc_id bigint, content binary")
    blocks = packages.mapInArrow(read, "doc_id bigint, block bigint, kind string, told string, section string")
    return blocks.select("doc_id", "block", "kind", F.md5("told").alias("told"), F.md5("section").alias("section"))


@query(rf"""WITH {TEXTS}, {OLD_FILES}, {NEW_FILES}, l AS (SELECT path, unnest(string_split_regex(text, '[\n\r]')) AS line, -1 AS n FROM old_files WHERE path IN (SELECT path FROM new_files)
  UNION ALL SELECT path, unnest(string_split_regex(text, '[\n\r]')), 1 FROM new_files WHERE path IN (SELECT path FROM old_files)),
c AS (SELECT path, line, sum(n) AS more, count(*) AS lines FROM (SELECT path, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line, n FROM l) WHERE line <> '' GROUP BY path, line)
SELECT o.path, coalesce(sum(lines), 0)::BIGINT AS n_lines, coalesce(sum(greatest(more, 0)), 0)::BIGINT AS n_added, coalesce(sum(greatest(-more, 0)), 0)::BIGINT AS n_removed FROM old_files o JOIN new_files n ON o.path = n.path LEFT JOIN c ON c.path = o.path GROUP BY o.path""")
def line_changes(spark, sf_dir):
    old, new = old_files(spark, sf_dir), new_files(spark, sf_dir)
    return changes(old.select("path", F.col("text").alias("old")).join(new.select("path", F.col("text").alias("new")), "path"))


@query(f"""WITH {LINKS}, p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages)
SELECT page_id, target, nth FROM links JOIN p USING (page_id) WHERE lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) = host AND starts_with(regexp_extract(target, '^[^/]*//[^/]*(/.*)?$', 1), '/t')""")
def site_links(spark, sf_dir):
    """Links that stay on their page's host, below one prefix."""
    return pages.links(table(spark, sf_dir, "pages"), same_host=True, prefix="/t")


LISTED = """SELECT '{name}' AS list, place, path, modified_at FROM (SELECT path, modified_at, row_number() OVER (ORDER BY {order}) AS place FROM old_files WHERE {where}) WHERE place <= 10"""


@query(f"""WITH {TEXTS}, {OLD_FILES} SELECT list, place, path, strftime(modified_at, '%Y-%m-%d') AS modified FROM ({LISTED.format(name="recent", order="modified_at DESC, path", where="true")}
UNION ALL {LISTED.format(name="stale", order="modified_at, path", where=f"modified_at < TIMESTAMP '{BASE}' - INTERVAL 180 DAY")} UNION ALL {LISTED.format(name="empty", order="path", where="size_bytes = 0")})""")
def document_lists(spark, sf_dir):
    listed = document_listings(old_files(spark, sf_dir), F.expr(f"timestamp_ntz'{BASE}'"))
    return listed.select("list", F.col("place").cast("bigint").alias("place"), "path", F.date_format("modified_at", "yyyy-MM-dd").alias("modified"))
