"""Registered queries over smaller operators: admission, names, sizes, overviews, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import models
from quarrystone.functions.text import sniffed_headings
from quarrystone.operators import admission
from quarrystone.operators.context import source_label
from quarrystone.operators.quality_reports import storage_sizes as sizes
from quarrystone.operators.names import lookup_names
from quarrystone.operators import history as H
from quarrystone import store
from quarrystone.operators import history_writes as history_writes_
from quarrystone.plans import answering
from quarrystone.plans.history_queries import WEAK
from quarrystone.plans.inputs import BASE, FEEDBACK, MESSAGES, NEW_FILES, NOW, OLD_FILES, SESSIONS, TEXTS, feedback, line_chunks, line_chunks_sql, messages, new_files, old_files, sessions, texts, users
from quarrystone.plans.model_queries import longest_sql
from quarrystone.plans.registry import query, table
from quarrystone.plans.reindex import reindex
from quarrystone.plans.retrieval_queries import fused_documents, questions
from quarrystone.plans.text_queries import CHUNKS, fixed
from quarrystone.streaming.streams import work_folder


@query("SELECT doc_id, md5(CASE WHEN lang <> 'en' THEN 'from ' || source || chr(10) || chr(10) || text ELSE text END) AS digest FROM documents")
def embed_text(spark, sf_dir):
    prefix = F.when(F.col("lang") != "en", F.concat(F.lit("from "), F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(answering.embed_text(prefix, F.col("text"))).alias("digest"))


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_index::INT AS chunk_index FROM chunks WHERE length(text) >= 80")
def min_length_filter(spark, sf_dir):
    return fixed(spark, sf_dir).filter(F.length("text") >= 80).select("doc_id", "chunk_index")


@query(f"WITH {MESSAGES}, {WEAK.format(limit=1000)} SELECT question, reason, count(*) AS answers, min(message_id) AS message_id FROM weak WHERE question IS NOT NULL GROUP BY question, reason")
def basket_export(spark, sf_dir):
    weak = H.weak_answers(messages(spark, sf_dir), 1000).filter(F.col("question").isNotNull())
    return weak.groupBy("question", "reason").agg(F.count("*").alias("answers"), F.min("message_id").alias("message_id"))


@query(f"SELECT event_type, event_id FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 5 DAY QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 50")
def latest_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return admission.latest(rows, "event_type", "ts", "event_id", F.expr(f"timestamp_ntz'{NOW}' - interval 5 day"), 50).select("event_type", "event_id")


@query("""WITH wanted AS (SELECT DISTINCT 'SRC' || (conv_id % 7 + turn) AS label FROM conversations), known AS (SELECT DISTINCT source FROM documents)
SELECT label, arg_min(source, (CASE WHEN lower(label) = source THEN 0 ELSE 1 END, length(source), source)) AS source FROM wanted, known
WHERE lower(label) = source OR contains(source, lower(label)) OR contains(lower(label), source) GROUP BY label""")
def source_lookup(spark, sf_dir):
    """A label's source: the exact one, else one that holds it or is held by it."""
    wanted = table(spark, sf_dir, "conversations").select(F.concat(F.lit("SRC"), (F.col("conv_id") % 7 + F.col("turn")).cast("string")).alias("label")).distinct()
    return lookup_names(wanted, table(spark, sf_dir, "documents").select("source").distinct())


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '(?s)<h[1-6][^>]*>(.*?)</h', 1)[1:5], ' | ') AS headings FROM pages")
def heading_sniff(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", sniffed_headings("html").alias("headings"))


@query(f"""WITH {TEXTS}, {OLD_FILES} SELECT path, CASE WHEN size_bytes > 5000 THEN 'too_large' WHEN path LIKE '%.txt' THEN 'text' ELSE 'rejected' END AS kind FROM old_files""")
def upload_filter(spark, sf_dir):
    f = old_files(spark, sf_dir)
    return f.select("path", F.when(F.col("size_bytes") > 5000, "too_large").otherwise(admission.attachment_kind(F.col("path"))).alias("kind"))


@query(r"SELECT conv_id, turn, length(text) BETWEEN 3 AND 1000 AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') AS valid FROM conversations")
def input_validation(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", admission.valid_text(F.col("text")).alias("valid"))


@query(f"WITH {TEXTS}, {OLD_FILES} SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS file_type, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM old_files GROUP BY 1, 2")
def storage_sizes(spark, sf_dir):
    return sizes(old_files(spark, sf_dir))


@query(f"WITH {MESSAGES}, {SESSIONS} SELECT session_id FROM sessions WHERE user_id = 31 OR (user_id IS NULL AND session_id IN (SELECT doc_id FROM labels WHERE quality = 0))")
def session_access(spark, sf_dir):
    held = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("session_id"))
    return admission.accessible(sessions(spark, sf_dir), 31, held).select("session_id")


@query("SELECT c_custkey::BIGINT AS user_id FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000007')")
def user_lookup(spark, sf_dir):
    return users(spark, sf_dir).filter(F.lower("name") == "customer#000000007").select("user_id")


@query(f"WITH {MESSAGES} SELECT message_id, coalesce(nullif(trim(s->>'source'), ''), nullif(trim(s->>'title'), ''), 'N/A') AS label FROM (SELECT message_id, unnest(from_json(sources_json::JSON, '[\"JSON\"]')) AS s FROM messages WHERE sources_json IS NOT NULL)")
def source_labels(spark, sf_dir):
    rows = messages(spark, sf_dir).select("message_id", F.explode(F.from_json("sources_json", H.SOURCES)).alias("s"))
    return rows.select("message_id", source_label("s.source", "s.title").alias("label"))


@query(f"""WITH {MESSAGES}, {SESSIONS}, {FEEDBACK}, {WEAK.format(limit=1000)} SELECT 'sessions' AS metric, count(*) AS value FROM sessions UNION ALL SELECT 'messages', count(*) FROM messages
UNION ALL SELECT 'up', count(*) FROM feedback WHERE rating = 'up' UNION ALL SELECT 'down', count(*) FROM feedback WHERE rating = 'down' UNION ALL SELECT 'weak', count(*) FROM weak
UNION ALL SELECT 'recent_sessions', count(*) FROM sessions WHERE updated_at >= TIMESTAMP '{BASE}' + INTERVAL 2 DAY""")
def admin_overview(spark, sf_dir):
    s, m, f = sessions(spark, sf_dir), messages(spark, sf_dir), feedback(spark, sf_dir)
    recent = F.col("updated_at") >= F.expr(f"timestamp_ntz'{BASE}' + interval 2 day")
    one = s.agg(F.count("*").alias("sessions"), F.count_if(recent).alias("recent_sessions")).join(m.agg(F.count("*").alias("messages")))
    one = one.join(f.agg(F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"))).join(H.weak_answers(m, 1000).agg(F.count("*").alias("weak")))
    return one.unpivot([], ["sessions", "messages", "up", "down", "weak", "recent_sessions"], "metric", "value")


@query(f"""WITH RECURSIVE {CHUNKS}, p AS (SELECT doc_id || '_' || chunk_index AS key, 'Situate this passage of doc ' || doc_id || ':' || chr(10) || substr(text, 1, 900) AS prompt FROM chunks WHERE chunk_index < 80 AND length(text) >= 40)
SELECT key, substr('["' || array_to_string({longest_sql("prompt")}, '", "') || '"]', 1, 500) AS prefix FROM p""")
def contextual_prefix(spark, sf_dir):
    chunks = fixed(spark, sf_dir).join(texts(spark, sf_dir).select("doc_id", "title"), "doc_id").withColumn("key", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))
    return answering.contextual_prefixes(chunks, models.EchoGenerator(), "key")


@query()
def answer_with_citations(spark, sf_dir):
    found = fused_documents(spark, sf_dir).withColumn("title", F.col("source"))
    return answering.answer(found, questions(spark, sf_dir), answering.TemplateGenerator())


@query(f"WITH {TEXTS}, {OLD_FILES}, {line_chunks_sql('c', 'old_files')} SELECT path, count(chunk_id)::INT AS chunks FROM old_files LEFT JOIN c USING (path) GROUP BY path")
def index_build(spark, sf_dir):
    files = old_files(spark, sf_dir)
    root = work_folder(spark, "index")
    store.publish(spark, root, answering.build_index(spark, root, files.drop("text"), line_chunks(files), models.HashEmbedder()))
    return spark.read.parquet(f"{store.current(spark, root)}/manifest").select("path", F.size("chunk_ids").alias("chunks"))


@query(f"WITH {TEXTS}, {NEW_FILES}, {line_chunks_sql('c', 'new_files')} SELECT path, count(chunk_id)::INT AS chunks, count(chunk_id) AS vectors FROM new_files LEFT JOIN c USING (path) GROUP BY path")
def reindex_incremental(spark, sf_dir):
    """Built from the old snapshot, then brought up to the new one: only new and changed files are chunked and embedded."""
    root = work_folder(spark, "reindex")
    keep = ["path", "title", "size_bytes", "mtime", "sha256", "text"]
    for files in (old_files(spark, sf_dir), new_files(spark, sf_dir)):
        done = reindex(spark, root, files.select(*keep), line_chunks, models.HashEmbedder(), body=("text",))
    vectors = spark.read.parquet(f"{done.version}/chunks").join(spark.read.parquet(f"{done.version}/vectors"), "chunk_id").groupBy("path").agg(F.count("*").alias("vectors"))
    rows = spark.read.parquet(f"{done.version}/manifest").join(vectors, "path", "left")
    return rows.select("path", F.size("chunk_ids").alias("chunks"), F.coalesce("vectors", F.lit(0)).alias("vectors"))


EVENTS = """a AS (SELECT conv_id * 100 + turn AS exchange, text AS answer FROM conversations WHERE role = 'assistant'),
d AS (SELECT exchange, answer, regexp_extract_all(answer, '(?s).{1,200}') AS parts FROM a)"""


@query(f"""WITH {EVENTS} SELECT exchange, 0 AS seq, 'status' AS type, 'answering' AS payload FROM d
UNION ALL SELECT exchange, i, 'delta', parts[i] FROM (SELECT exchange, parts, unnest(range(1, len(parts) + 1)) AS i FROM d WHERE trim(coalesce(answer, '')) <> '')
UNION ALL SELECT exchange, CASE WHEN trim(coalesce(answer, '')) = '' THEN 1 ELSE len(parts) + 1 END, CASE WHEN trim(coalesce(answer, '')) = '' THEN 'error' ELSE 'done' END, CASE WHEN trim(coalesce(answer, '')) = '' THEN 'no answer' ELSE len(parts)::VARCHAR END FROM d""")
def answer_events(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("exchange"), F.col("text").alias("answer"))
    return answering.answer_events(rows, "exchange").withColumn("seq", F.col("seq").cast("bigint"))


@query("""WITH s AS (SELECT conv_id AS session_id, max(turn) AS latest FROM conversations GROUP BY conv_id)
SELECT session_id, latest + (session_id % 3 = 0)::INT AS turns, CASE WHEN session_id % 3 = 0 THEN 'added ' || session_id ELSE 'kept' END AS last FROM s""")
def history_writes(spark, sf_dir):
    """A message is added to every third session, twice under one id, and one to a session that isn't there."""
    made = messages(spark, sf_dir)
    schema = [c for c in made.columns if c != "turn"]
    opened = sessions(spark, sf_dir)
    late = made.groupBy("session_id").agg(F.max(F.struct("turn", "created_at")).alias("m"))
    new = late.filter("session_id % 3 = 0").select((F.col("session_id") * 100 + F.col("m.turn") + 1).alias("message_id"), "session_id", F.lit("user").alias("role"), F.concat(F.lit("added "), F.col("session_id").cast("string")).alias("content"), F.lit(None).cast("string").alias("sources_json"), F.lit(None).cast("string").alias("metadata_json"), (F.col("m.created_at") + F.expr("interval 1 minute")).alias("created_at"))
    lost = new.limit(1).withColumns({"message_id": F.lit(-1).cast("bigint"), "session_id": F.lit(-1).cast("bigint")})
    after, told = history_writes_.add_messages(opened, made.select(*schema), new.unionByName(new).unionByName(lost).select(*schema))
    last = told.groupBy("session_id").agg(F.max(F.struct("created_at", "message_id", "content")).alias("m"))
    touched = after.join(last, "session_id").filter(F.col("updated_at") == F.col("m.created_at"))
    return touched.select("session_id", (F.col("m.message_id") % 100).alias("turns"), F.when(F.col("m.content").startswith("added "), F.col("m.content")).otherwise("kept").alias("last"))


@query("SELECT count(*) AS requests, count(*) FILTER (WHERE known) AS hits, count(*) FILTER (WHERE NOT known) AS misses, round(count(*) FILTER (WHERE known) / count(*), 4) AS hit_rate, (SELECT count(DISTINCT md5(text)) FROM conversations WHERE conv_id % 2 = 0) AS entries FROM (SELECT text IN (SELECT text FROM conversations WHERE conv_id % 2 = 0) AS known FROM conversations)")
def cache_statistics(spark, sf_dir):
    """Every message as a request to a cache that half of the conversations filled."""
    told = table(spark, sf_dir, "conversations").withColumn("key", F.sha2("text", 256))
    cache = told.filter("conv_id % 2 = 0").select("key").distinct()
    return models.cache_statistics(cache, told.select("key"))
