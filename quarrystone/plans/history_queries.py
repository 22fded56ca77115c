"""Registered queries over chat history."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.operators import history as H
from quarrystone.plans.inputs import FEEDBACK, MESSAGES, NOW, SESSIONS, feedback, messages, sessions, users
from quarrystone.plans.registry import query
from quarrystone.plans.text_queries import STOP_WORDS

STAMP = "%Y-%m-%d %H:%M:%S"
LABEL = "CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END"


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


@query(f"WITH {MESSAGES} SELECT session_id, message_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at, message_id) AS position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC) AS b FROM messages) WHERE b <= 4")
def recent_messages(spark, sf_dir):
    return H.recent_messages(messages(spark, sf_dir), 4).select("session_id", "message_id", F.col("position").cast("bigint").alias("position"))


@query(rf"""WITH {MESSAGES}, l AS (SELECT session_id, created_at, message_id, {LABEL} || ': ' || CASE WHEN length(c) > 300 THEN rtrim(substr(c, 1, 297)) || '...' ELSE c END AS line FROM (
  SELECT *, trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g')) AS c, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, message_id DESC) AS b FROM messages) WHERE b <= 6)
SELECT session_id, string_agg(line, chr(10) ORDER BY created_at, message_id) AS history FROM l GROUP BY session_id""")
def history_block(spark, sf_dir):
    return H.history_blocks(messages(spark, sf_dir), 6, 300)


@query(f"WITH {MESSAGES}, {SESSIONS} SELECT session_id, title, strftime(updated_at, '{STAMP}') AS updated_at FROM sessions ORDER BY sessions.updated_at DESC, session_id LIMIT 20 OFFSET 10")
def session_list(spark, sf_dir):
    return H.session_page(sessions(spark, sf_dir), 20, 10).select("session_id", "title", stamp("updated_at").alias("updated_at"))


@query(f"""WITH {MESSAGES}, {SESSIONS} SELECT session_id, title FROM sessions s WHERE translate(coalesce(title, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%thed_r%'
  OR session_id IN (SELECT session_id FROM messages WHERE translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%thed_r%')""")
def session_search(spark, sf_dir):
    return H.search_sessions(sessions(spark, sf_dir), messages(spark, sf_dir), "Thed_r").select("session_id", "title")


@query(f"WITH {MESSAGES}, {SESSIONS} SELECT session_id FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = s.user_id) AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 2 DAY ORDER BY updated_at, session_id LIMIT 10000")
def orphan_sessions(spark, sf_dir):
    cutoff = F.expr(f"timestamp_ntz'{NOW}' - interval 2 day")
    return H.retention_candidates(sessions(spark, sf_dir), users(spark, sf_dir), cutoff, 10_000).select("session_id")


@query(f"WITH {FEEDBACK} SELECT count(*) FILTER (WHERE rating = 'up') AS up, count(*) FILTER (WHERE rating = 'down') AS down, count(*) AS total FROM feedback WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 5 DAY")
def feedback_summary(spark, sf_dir):
    return H.feedback_summary(feedback(spark, sf_dir), F.expr(f"timestamp_ntz'{NOW}' - interval 5 day"))


@query(f"""WITH {MESSAGES}, {SESSIONS}, {FEEDBACK} SELECT feedback_id, rating, content AS message, title AS session_title FROM feedback f LEFT JOIN messages m ON f.message_id = m.message_id
LEFT JOIN sessions s ON f.session_id = s.session_id ORDER BY f.created_at DESC, feedback_id DESC LIMIT 500""")
def feedback_context(spark, sf_dir):
    return H.feedback_context(feedback(spark, sf_dir), messages(spark, sf_dir), sessions(spark, sf_dir), 500).select("feedback_id", "rating", "message", "session_title")


SOURCE_ROWS = """src AS (SELECT message_id, created_at, i, s, coalesce(nullif(trim(s->>'path'), ''), nullif(trim(s->>'title'), ''), nullif(trim(s->>'source'), ''), 'N/A') AS source_key
  FROM (SELECT message_id, created_at, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT message_id, created_at, from_json(sources_json::JSON, '["JSON"]') AS l FROM used)))
SELECT source_key, count(*) AS uses, arg_min(s->>'title', (-epoch_us(created_at), -message_id, i)) AS title FROM src GROUP BY source_key ORDER BY uses DESC, source_key LIMIT 25"""


@query(f"WITH {MESSAGES}, used AS (SELECT * FROM messages WHERE role = 'assistant' AND sources_json IS NOT NULL ORDER BY created_at DESC, message_id DESC LIMIT 10000), {SOURCE_ROWS}")
def top_sources(spark, sf_dir):
    return H.top_sources(messages(spark, sf_dir), 25)


@query(f"WITH {MESSAGES}, {FEEDBACK}, used AS (SELECT m.* FROM feedback f JOIN messages m ON f.message_id = m.message_id WHERE rating = 'down' AND sources_json IS NOT NULL), {SOURCE_ROWS}")
def negative_sources(spark, sf_dir):
    return H.negative_sources(feedback(spark, sf_dir), messages(spark, sf_dir), 25)


WEAK = """scan AS (SELECT * FROM messages WHERE role IN ('user', 'assistant') ORDER BY created_at DESC, message_id DESC LIMIT 10000),
asked AS (SELECT *, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY created_at, message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM scan),
judged AS (SELECT *, CASE WHEN metadata_json->>'retrieve_error' <> '' THEN 'retrieve_error'
  WHEN coalesce(metadata_json->'diagnostics'->>'retrieval_status', metadata_json->>'retrieve_error') IN ('search_error', 'embedding_unavailable', 'no_hits') THEN 'bad_status'
  WHEN sources_json = '[]' THEN 'no_sources'
  WHEN list_max(list_transform(from_json(sources_json::JSON, '["JSON"]'), lambda s: (s->>'score')::DOUBLE)) < 0.35 THEN 'low_score' END AS reason FROM asked WHERE role = 'assistant'),
weak AS (SELECT message_id, session_id, question, reason, created_at FROM judged WHERE reason IS NOT NULL ORDER BY created_at DESC, message_id DESC LIMIT {limit})"""


@query(f"WITH {MESSAGES}, {WEAK.format(limit=1000)} SELECT message_id, session_id, question, reason, strftime(created_at, '{STAMP}') AS created_at FROM weak")
def weak_answers(spark, sf_dir):
    return H.weak_answers(messages(spark, sf_dir), 1000).withColumn("created_at", stamp("created_at"))


@query(rf"""WITH {MESSAGES}, {WEAK.format(limit=1000)},
keyed AS (SELECT *, CASE WHEN k <> '' THEN k ELSE substr(lower(trim(question)), 1, 80) END AS topic FROM (SELECT *, array_to_string(list_filter(regexp_extract_all(lower(question), '\p{{L}}{{4,}}'), lambda w: w NOT IN ('tion', 'that', 'this', 'with', 'from'))[1:5], ' ') AS k FROM weak WHERE trim(coalesce(question, '')) <> '')),
r AS (SELECT topic, reason, count(*) AS n, max((created_at, message_id)) AS newest FROM keyed GROUP BY topic, reason),
g AS (SELECT topic, count(*) AS answers, arg_min(question, (created_at, message_id)) AS last_question, min(created_at) AS seen FROM keyed GROUP BY topic)
SELECT g.topic, answers, (SELECT reason FROM r WHERE r.topic = g.topic ORDER BY n DESC, newest DESC, reason DESC LIMIT 1) AS reason, last_question, strftime(seen, '{STAMP}') AS last_seen_at FROM g ORDER BY answers DESC, seen DESC, g.topic LIMIT 50""")
def knowledge_gaps(spark, sf_dir):
    return H.knowledge_gaps(messages(spark, sf_dir), 50, STOP_WORDS).withColumn("last_seen_at", stamp("last_seen_at"))


@query(f"WITH {MESSAGES} SELECT session_id, string_agg('## ' || {LABEL} || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY created_at, message_id) AS markdown FROM messages GROUP BY session_id")
def export_markdown(spark, sf_dir):
    return H.markdown_export(messages(spark, sf_dir))


@query(f"WITH {MESSAGES}, {SESSIONS} SELECT count(DISTINCT s.session_id) AS sessions, count(m.message_id) AS messages, count(*) FILTER (WHERE role = 'assistant') AS answers FROM sessions s JOIN messages m ON s.session_id = m.session_id")
def history_counts(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.join(sessions(spark, sf_dir).select("session_id"), "session_id").groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "assistant").alias("a")).agg(F.count("*").alias("sessions"), F.sum("n").alias("messages"), F.sum("a").alias("answers"))


@query(f"""WITH {MESSAGES}, {SESSIONS}, {FEEDBACK}, gone AS (SELECT session_id FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = s.user_id))
SELECT (SELECT count(*) FROM sessions WHERE session_id NOT IN (SELECT session_id FROM gone)) AS sessions, (SELECT count(*) FROM messages WHERE session_id NOT IN (SELECT session_id FROM gone)) AS messages,
  (SELECT count(*) FROM feedback WHERE session_id NOT IN (SELECT session_id FROM gone)) AS votes,
  (SELECT count(*) FROM feedback WHERE session_id NOT IN (SELECT session_id FROM gone) AND message_id IN (SELECT message_id FROM messages)) AS linked""")
def cascade_delete(spark, sf_dir):
    s, m, f = sessions(spark, sf_dir), messages(spark, sf_dir), feedback(spark, sf_dir)
    gone = s.join(users(spark, sf_dir).select("user_id"), "user_id", "left_anti")
    s, m, f = H.delete_sessions(s, m, f, gone)
    counts = s.agg(F.count("*").alias("sessions")).join(m.agg(F.count("*").alias("messages")))
    return counts.join(f.agg(F.count("*").alias("votes"), F.count("message_id").alias("linked")))
