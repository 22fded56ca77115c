"""The engine's entities over the shared tables, as DataFrames and as SQL.

documents are extracted texts, pages are crawled pages, conversations are chat sessions, labels are votes, customers are users,
benchmark passages are questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.text import chat_title
from quarrystone.plans.registry import table

#: The moment that stands for "now" in registered queries.
NOW = "2024-01-06 00:00:00"
BASE = "2024-01-01 00:00:00"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their path and title."""
    docs = table(spark, sf_dir, "documents")
    return docs.withColumn("path", F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))).withColumn("title", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))


TEXTS = "texts AS (SELECT *, source || '/' || doc_id || '.txt' AS path, 'doc ' || doc_id AS title FROM documents)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages; sources and diagnostics of answers follow from session and turn."""
    rows = table(spark, sf_dir, "conversations").withColumn("mark", F.expr("(conv_id * 7 + turn) % 5"))
    made = F.expr("""CASE WHEN role <> 'assistant' THEN NULL WHEN mark = 0 THEN '[]' ELSE concat(
        '[{"title":"title ', conv_id % 13, '","source":"src', conv_id % 7, '","path":"src', conv_id % 7, '/', conv_id % 13, '.txt","score":0.', mark, '5},',
        '{"title":"title ', turn, '","source":"src', turn, '","path":"","score":0.', turn % 3, '}]') END""")
    meta = F.expr("""CASE WHEN role <> 'assistant' THEN NULL WHEN conv_id % 9 = 0 THEN '{"retrieve_error":"timeout"}'
        WHEN conv_id % 9 = 1 THEN '{"diagnostics":{"retrieval_status":"no_hits"}}' ELSE '{}' END""")
    at = F.expr(f"timestamp_ntz'{BASE}' + make_dt_interval(0, cast(conv_id as int), cast(turn as int), 0)")
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"), made.alias("sources_json"), meta.alias("metadata_json"), at.alias("created_at"))


MESSAGES = f"""messages AS (SELECT conv_id * 100 + turn AS message_id, conv_id AS session_id, turn, role, text AS content,
  CASE WHEN role <> 'assistant' THEN NULL WHEN (conv_id * 7 + turn) % 5 = 0 THEN '[]' ELSE concat(
    '[{{"title":"title ', conv_id % 13, '","source":"src', conv_id % 7, '","path":"src', conv_id % 7, '/', conv_id % 13, '.txt","score":0.', (conv_id * 7 + turn) % 5, '5}},',
    '{{"title":"title ', turn, '","source":"src', turn, '","path":"","score":0.', turn % 3, '}}]') END AS sources_json,
  CASE WHEN role <> 'assistant' THEN NULL WHEN conv_id % 9 = 0 THEN '{{"retrieve_error":"timeout"}}' WHEN conv_id % 9 = 1 THEN '{{"diagnostics":{{"retrieval_status":"no_hits"}}}}' ELSE '{{}}' END AS metadata_json,
  TIMESTAMP '{BASE}' + to_hours(conv_id) + to_minutes(turn) AS created_at FROM conversations)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session a conversation; some have no user, and some a user that is gone."""
    m = messages(spark, sf_dir)
    first = F.min(F.when(F.col("role") == "user", F.struct("turn", "content")))["content"]
    made = m.groupBy("session_id").agg(first.alias("first"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    user = F.expr("CASE WHEN session_id % 5 = 0 THEN NULL ELSE session_id * 31 END")
    return made.select("session_id", user.alias("user_id"), chat_title("first").alias("title"), "created_at", "updated_at")


SESSIONS = r"""sessions AS (SELECT session_id, CASE WHEN session_id % 5 = 0 THEN NULL ELSE session_id * 31 END AS user_id,
  CASE WHEN length(t) > 60 THEN substr(t, 1, 57) || '...' ELSE t END AS title, created_at, updated_at
  FROM (SELECT session_id, trim(regexp_replace(coalesce(arg_min(content, turn) FILTER (WHERE role = 'user'), ''), '\s+', ' ', 'g')) AS t, min(created_at) AS created_at, max(created_at) AS updated_at FROM messages GROUP BY session_id))"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as votes on messages."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("feedback_id"),
        F.expr("(doc_id div 8) * 100 + doc_id % 8").alias("message_id"),
        F.expr("doc_id div 8").alias("session_id"),
        F.expr("CASE WHEN quality = 0 THEN 'down' WHEN toxic = 1 THEN 'neutral' ELSE 'up' END").alias("rating"),
        F.expr(f"timestamp_ntz'{BASE}' + make_dt_interval(0, 0, cast(doc_id as int), 0)").alias("created_at"),
    )


FEEDBACK = f"""feedback AS (SELECT doc_id AS feedback_id, (doc_id // 8) * 100 + doc_id % 8 AS message_id, doc_id // 8 AS session_id,
  CASE WHEN quality = 0 THEN 'down' WHEN toxic = 1 THEN 'neutral' ELSE 'up' END AS rating, TIMESTAMP '{BASE}' + to_minutes(doc_id) AS created_at FROM labels)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("user_id"), F.col("c_name").alias("name"))


def old_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file snapshot of the last index run: all documents."""
    d = texts(spark, sf_dir)
    return d.select("path", "title", F.col("n_chars").alias("size_bytes"), F.lit(1).alias("mtime"), F.sha2("text", 256).alias("sha256"), "text", F.expr(f"timestamp_ntz'{BASE}' - make_dt_interval(cast(doc_id % 400 as int), 0, 0, 0)").alias("modified_at"))


OLD_FILES = f"""old_files AS (SELECT path, title, n_chars AS size_bytes, 1 AS mtime, sha256(text) AS sha256, text, TIMESTAMP '{BASE}' - to_days((doc_id % 400)::INT) AS modified_at FROM texts)"""


def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot now: toxic documents are deleted, bad ones are rewritten, and pages are new."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = texts(spark, sf_dir).join(labels, "doc_id", "left").filter("coalesce(toxic, 0) = 0")
    text = F.when(F.col("quality") == 0, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    d = d.select("path", "title", text.alias("text"))
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.col("html").alias("text"))
    return d.unionByName(p).select("path", "title", F.length("text").cast("bigint").alias("size_bytes"), F.lit(1).alias("mtime"), F.sha2("text", 256).alias("sha256"), "text")


NEW_FILES = """new_files AS (SELECT path, title, length(text) AS size_bytes, 1 AS mtime, sha256(text) AS sha256, text FROM (
  SELECT path, title, CASE WHEN quality = 0 THEN text || ' (revised)' ELSE text END AS text FROM texts t LEFT JOIN labels l ON t.doc_id = l.doc_id WHERE coalesce(toxic, 0) = 0
  UNION ALL SELECT 'pages/' || page_id || '.html', 'page ' || page_id, html FROM pages))"""


def line_chunks(files: DataFrame) -> DataFrame:
    """A simple chunking of snapshots: one chunk a line."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return lines.withColumn("chunk_id", F.md5(F.concat_ws("_", "path", F.col("chunk_index").cast("string"))))


def line_chunks_sql(name: str, files: str) -> str:
    return f"{name} AS (SELECT path, i - 1 AS chunk_index, lines[i] AS text, md5(path || '_' || (i - 1)) AS chunk_id FROM (SELECT path, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT path, string_split(text, chr(10)) AS lines FROM {files})))"
