"""Registered queries of index maintenance and document reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import manifest as M
from quarrystone.operators import quality_reports as Q
from quarrystone.plans.history_queries import WEAK
from quarrystone.plans.inputs import BASE, FEEDBACK, MESSAGES, NEW_FILES, OLD_FILES, TEXTS, feedback, line_chunks, line_chunks_sql, messages, new_files, old_files
from quarrystone.plans.registry import query, table
from quarrystone.sources import pages as P

#: Weak answers of the whole table.
EVERY_WEAK = WEAK.replace(" ORDER BY created_at DESC, message_id DESC LIMIT 10000", "").replace(" ORDER BY created_at DESC, message_id DESC LIMIT {limit}", "")

SNAPSHOTS = f"{TEXTS}, {OLD_FILES}, {NEW_FILES}"
DIFF = f"""{SNAPSHOTS}, diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.size_bytes = n.size_bytes AND o.mtime = n.mtime AND o.sha256 = n.sha256 THEN 'unchanged' ELSE 'changed' END AS status
  FROM old_files o FULL OUTER JOIN new_files n ON o.path = n.path)"""
BOTH_CHUNKS = f"{line_chunks_sql('old_chunks', 'old_files')}, {line_chunks_sql('new_chunks', 'new_files')}"


@query(f"WITH {SNAPSHOTS}, {line_chunks_sql('old_chunks', 'old_files')} SELECT f.path, title, size_bytes, sha256, string_agg(chunk_id, ',' ORDER BY chunk_index) AS chunk_ids FROM old_files f JOIN old_chunks c ON f.path = c.path GROUP BY f.path, title, size_bytes, sha256")
def manifest_build(spark, sf_dir):
    files = old_files(spark, sf_dir)
    built = M.build_manifest(files.drop("text"), line_chunks(files))
    return built.select("path", "title", "size_bytes", "sha256", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query(f"WITH {DIFF} SELECT path, status FROM diff")
def manifest_diff(spark, sf_dir):
    return M.diff_manifest(old_files(spark, sf_dir), new_files(spark, sf_dir))


@query(f"""WITH {DIFF}, {BOTH_CHUNKS} SELECT DISTINCT chunk_id FROM old_chunks JOIN diff USING (path) WHERE status IN ('deleted', 'changed') AND chunk_id NOT IN (SELECT chunk_id FROM new_chunks)""")
def stale_chunk_delete(spark, sf_dir):
    old, new = old_files(spark, sf_dir), new_files(spark, sf_dir)
    return M.stale_chunks(line_chunks(old), M.diff_manifest(old, new), line_chunks(new))


@query(f"""WITH {DIFF}, {BOTH_CHUNKS} SELECT chunk_id, md5(text) AS digest, 'kept' AS origin FROM old_chunks JOIN diff USING (path) WHERE status = 'unchanged'
UNION ALL SELECT chunk_id, md5(text), 'added' FROM new_chunks JOIN diff USING (path) WHERE status IN ('changed', 'new')""")
def incremental_apply(spark, sf_dir):
    old, new = old_files(spark, sf_dir), new_files(spark, sf_dir)
    return M.apply_increment(line_chunks(old), M.diff_manifest(old, new), line_chunks(new)).select("chunk_id", F.md5("text").alias("digest"), "origin")


@query(f"""WITH {DIFF} SELECT path, o.sha256 AS sha256 FROM old_files o JOIN diff USING (path) WHERE status = 'unchanged' UNION ALL SELECT path, n.sha256 FROM new_files n JOIN diff USING (path) WHERE status IN ('changed', 'new')""")
def manifest_merge(spark, sf_dir):
    old, new = old_files(spark, sf_dir), new_files(spark, sf_dir)
    return M.merge_manifest(old.select("path", "sha256"), M.diff_manifest(old, new), new.select("path", "sha256"))


@query(f"""WITH {SNAPSHOTS} SELECT lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS file_type, count(*) AS files, count(*) FILTER (WHERE modified_at < TIMESTAMP '{BASE}' - INTERVAL 180 DAY) AS stale, count(*) FILTER (WHERE size_bytes = 0) AS empty, sum(size_bytes)::BIGINT AS bytes FROM old_files GROUP BY 1""")
def doc_quality(spark, sf_dir):
    return Q.document_quality(old_files(spark, sf_dir), F.expr(f"timestamp_ntz'{BASE}'"))


NAMED = "named AS (SELECT lang || '/' || source || '/' || (doc_id % 97) || '.TXT' AS path, lower((doc_id % 97) || '.TXT') AS name FROM documents)"


@query(f"""WITH {NAMED}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS nth FROM named)
SELECT name, count(*) AS files, string_agg(path, ', ' ORDER BY path) FILTER (WHERE nth <= 5) AS paths FROM r GROUP BY name HAVING count(*) > 1 ORDER BY files DESC, name LIMIT 10""")
def duplicate_names(spark, sf_dir):
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), (F.col("doc_id") % 97).cast("string"), F.lit(".TXT"))
    return Q.duplicate_names(table(spark, sf_dir, "documents").select(path.alias("path")))


@query(f"""WITH {MESSAGES}, {FEEDBACK}, {EVERY_WEAK}, {NAMED}, s AS (SELECT count(*) FILTER (WHERE rating = 'up') AS up, count(*) FILTER (WHERE rating = 'down') AS down FROM feedback),
w AS (SELECT count(*) AS weak, count(*) FILTER (WHERE trim(coalesce(question, '')) <> '') AS gaps FROM weak),
d AS (SELECT count(*) FILTER (WHERE TIMESTAMP '{BASE}' - to_days((doc_id % 400)::INT) < TIMESTAMP '{BASE}' - INTERVAL 180 DAY) AS stale, count(*) FILTER (WHERE n_chars = 0) AS empty FROM documents),
n AS (SELECT count(*) AS doubled FROM (SELECT name FROM named GROUP BY name HAVING count(*) > 1))
SELECT array_to_string(list_filter([CASE WHEN down / greatest(up + down, 1) >= 0.1 THEN 'high_down_share' END, CASE WHEN weak > 0 THEN 'weak_answers' END, CASE WHEN gaps > 0 THEN 'knowledge_gaps' END,
  CASE WHEN stale > 0 THEN 'stale_documents' END, CASE WHEN doubled > 0 THEN 'duplicate_names' END, CASE WHEN empty > 0 THEN 'empty_documents' END], lambda x: x IS NOT NULL), ',') AS flags FROM s, w, d, n""")
def risk_flags(spark, sf_dir):
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), (F.col("doc_id") % 97).cast("string"), F.lit(".TXT"))
    age = F.expr(f"timestamp_ntz'{BASE}' - make_dt_interval(cast(doc_id % 400 as int), 0, 0, 0)")
    files = table(spark, sf_dir, "documents").select(path.alias("path"), F.col("n_chars").alias("size_bytes"), age.alias("modified_at"))
    return Q.risk_flags(Q.risk_summary(feedback(spark, sf_dir), messages(spark, sf_dir), files, F.expr(f"timestamp_ntz'{BASE}'")), 0.1)


RELATED = r"""d AS (SELECT lang || '/' || source || '/report ' || doc_id || '.txt' AS path, lang || '/' || source AS dir FROM documents),
s AS (SELECT lang || '/' || source || '/' || item_id || '.txt' AS source_path, lang || '/' || source AS source_dir, source || ' report.' || item_id AS title, item_id AS nth FROM benchmark JOIN documents ON item_id = doc_id),
dw AS (SELECT DISTINCT path, w FROM (SELECT path, unnest(regexp_split_to_array(replace(lower(path), '.', ' '), '[\s/]+')) AS w FROM d) WHERE length(w) > 3),
sw AS (SELECT DISTINCT source_path, w FROM (SELECT source_path, unnest(regexp_split_to_array(replace(lower(title), '.', ' '), '[\s/]+')) AS w FROM s) WHERE length(w) > 3),
p AS (SELECT source_path, path, least(count(*), 4) AS points FROM dw JOIN sw USING (w) GROUP BY ALL UNION ALL SELECT source_path, path, 9 FROM d JOIN s ON dir = source_dir),
t AS (SELECT source_path, path, sum(points)::BIGINT AS points FROM p WHERE path <> source_path GROUP BY ALL)
SELECT path, arg_max(source_path, (points, -nth)) AS source_path, max(points) AS points FROM t JOIN s USING (source_path) GROUP BY path ORDER BY points DESC, path LIMIT 50"""


@query(f"WITH {RELATED}")
def related_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder = F.concat("lang", F.lit("/"), "source")
    found = docs.select(F.concat(folder, F.lit("/report "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("nth")).join(docs, F.col("nth") == F.col("doc_id"))
    sources = items.select("nth", F.concat(folder, F.lit("/"), F.col("nth").cast("string"), F.lit(".txt")).alias("path"), F.concat("source", F.lit(" report."), F.col("nth").cast("string")).alias("title"))
    return Q.related_documents(found, sources, 50)


#: A new version has its last line revised, or a further line where the old one ends in a line break.
@query(rf"""WITH {SNAPSHOTS}, v AS (SELECT o.path, o.text AS old, n.text AS new, list_filter(list_transform(string_split_regex(o.text, '[\n\r]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l,
  regexp_replace(regexp_extract(o.text, '[^\n\r]*$'), '^\s+|\s+$', '', 'g') AS tail FROM old_files o JOIN new_files n ON o.path = n.path)
SELECT path, CASE WHEN old = new THEN 1.0 WHEN tail = '' THEN round_even(2.0::DOUBLE * len(l) / (2 * len(l) + 1), 3) ELSE round_even((len(l) - 1.0::DOUBLE) / len(l), 3) END AS ratio, (old <> new)::BIGINT AS n_added, (old <> new AND tail <> '')::BIGINT AS n_removed,
  CASE WHEN old = new THEN '' ELSE trim(tail || ' (revised)') END AS added, CASE WHEN old = new THEN '' ELSE tail END AS removed FROM v""")
def version_diff(spark, sf_dir):
    from quarrystone.session import prepare

    prepare(spark, 512)
    old, new = old_files(spark, sf_dir), new_files(spark, sf_dir)
    told = Q.version_diff(old.select("path", F.col("text").alias("old")).join(new.select("path", F.col("text").alias("new")), "path"))
    return told.withColumns({c: F.array_join(c, "\n") for c in ("added", "removed")})


def plain_sql(html: str) -> str:
    """SQL for the text between tags, with the entities that pages hold."""
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        html = f"replace({html}, '{entity}', '{mark}')" if entity != "&lt;" else f"replace(regexp_replace({html}, '<[^>]*>', ' ', 'g'), '{entity}', '{mark}')"
    return rf"trim(regexp_replace({html}, '[\s\x{{A0}}\x{{2000}}-\x{{200A}}\x{{3000}}]+', ' ', 'g'))"


ARTICLE = r"regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style|nav|footer|header)[ >].*?</(script|style|nav|footer|header)>', ' ', 'g')"
TITLE = r"regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"


@query(f"SELECT page_id, {plain_sql(TITLE)} AS title, {plain_sql(ARTICLE)} AS text, NULL::VARCHAR AS error FROM pages")
def html_extract(spark, sf_dir):
    return P.extract_pages(table(spark, sf_dir, "pages"))


@query()
def html_chunks(spark, sf_dir):
    return P.page_chunks(table(spark, sf_dir, "pages"))


#: Addresses as ``normal_url`` has them, and the distinct targets of each page's links with their first place.
NORMAL = r"(lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) || regexp_replace(regexp_replace(substr({u}, length(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) + 1), '/{{2,}}', '/', 'g'), '/$', ''))"
BARE = r"regexp_replace(trim({u}), '[?#].*$', '')"
LINKS = rf"""a AS (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*?href="([^"]+)"', 1) AS l FROM pages),
h AS (SELECT page_id, url, l[i] AS href, i - 1 AS nth FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM a)),
t AS (SELECT page_id, nth, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN href[1] = '/' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1) || href
  ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END AS target FROM h WHERE href[1] <> '#'),
links AS (SELECT page_id, {NORMAL.format(u=BARE.format(u='target'))} AS target, min(nth) AS nth FROM t GROUP BY ALL)"""


@query(f"WITH {LINKS} SELECT * FROM links")
def page_links(spark, sf_dir):
    return P.links(table(spark, sf_dir, "pages"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS raw_title FROM pages")
def page_titles(spark, sf_dir):
    raw = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(raw, r"\s+", " ")).alias("raw_title"))


@query()
def preview(spark, sf_dir):
    return P.preview(table(spark, sf_dir, "pages"))


@query(rf"""WITH RECURSIVE {LINKS}, fetched AS (SELECT {NORMAL.format(u=BARE.format(u='url'))} AS url, min(page_id) AS page_id FROM pages GROUP BY ALL),
edges AS (SELECT DISTINCT f.url AS origin, target FROM links JOIN fetched f USING (page_id) JOIN fetched g ON g.url = target),
walk AS (SELECT min(url) AS url, 0 AS depth FROM fetched GROUP BY regexp_extract(url, '^([^/]*//[^/]*)', 1)
  UNION SELECT target, depth + 1 FROM walk JOIN edges ON origin = walk.url WHERE depth < (SELECT count(*) FROM fetched))
SELECT url, coalesce(min(depth), -1)::BIGINT AS depth FROM fetched LEFT JOIN walk USING (url) GROUP BY url""")
def crawl_frontier(spark, sf_dir):
    """Depths of all pages; -1 where no link leads."""
    return P.crawl_order(table(spark, sf_dir, "pages")).select("url", F.coalesce("depth", F.lit(-1)).cast("bigint").alias("depth"))
