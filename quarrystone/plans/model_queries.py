"""Registered queries that use models or streams; SQL cannot express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import models
from quarrystone.operators import bm25
from quarrystone.operators.fusion import fused_topk
from quarrystone.plans.registry import query, table
from quarrystone.plans.text_queries import CHUNKS
from quarrystone.plans.retrieval import deep_retrieve, retrieve
from quarrystone.plans.retrieval_queries import FUSED, document_index, fused_documents, questions
from quarrystone.streaming import streams


def words_sql(text: str) -> str:
    """SQL for the distinct words of a text."""
    return rf"list_distinct(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'))"


def longest_sql(text: str) -> str:
    """SQL for what the stand-in generator answers: the four longest words of six letters or more."""
    return rf"list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{6,}}')), lambda w: {{'n': -length(w), 'w': w}}))[1:4], lambda x: x.w)"


@query(f"""WITH RECURSIVE {FUSED}, p AS (SELECT query_id, doc_id, position, {words_sql("b.text")} AS asked, {words_sql("substr(coalesce(d.text, ''), 1, 4000)")} AS held FROM best JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id WHERE position <= 5),
s AS (SELECT query_id, doc_id, position, 1 / (1 + exp(3 - 6.0::DOUBLE * len(list_intersect(asked, held)) / greatest(1, len(asked)))) AS score FROM p)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS position FROM s""")
def rerank_stub(spark, sf_dir):
    found = fused_documents(spark, sf_dir).select("query_id", "doc_id", "text", "score", "position")
    judged = models.rerank(found, questions(spark, sf_dir), models.OverlapReranker())
    return judged.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("position").cast("bigint").alias("position"))


@query(f"""WITH w AS (SELECT item_id AS query_id, text, {longest_sql("text")} AS l FROM benchmark)
SELECT query_id, 0 AS nth, text FROM w UNION ALL SELECT query_id, i::INT, l[i] FROM (SELECT query_id, l, unnest(range(1, len(l) + 1)) AS i FROM w)""")
def query_expansion(spark, sf_dir):
    return models.expand(questions(spark, sf_dir), models.EchoGenerator())


def told_sql(prompt: str) -> str:
    """SQL for what the stand-in generator answers to a prompt, as text."""
    return f"""'["' || array_to_string({longest_sql(prompt)}, '", "') || '"]'"""


@query(f"""WITH h AS (SELECT conv_id AS query_id, arg_min(text, turn) AS history FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY conv_id),
q AS (SELECT item_id AS query_id, text, coalesce(history, '') AS history FROM benchmark LEFT JOIN h ON query_id = item_id),
v AS (SELECT query_id, {longest_sql("'Give other wordings as a JSON array.' || chr(10) || text")} AS l FROM q),
a AS (SELECT query_id, 0 AS place, 'question' AS kind, text FROM q
  UNION ALL SELECT query_id, 1, 'rewriting', {told_sql("'Rewrite the question so that it stands alone.' || chr(10) || history || chr(10) || text")} FROM q WHERE trim(history) <> ''
  UNION ALL SELECT query_id, 1 + i, 'variant', l[i] FROM (SELECT query_id, l, unnest(range(1, len(l) + 1)) AS i FROM v)
  UNION ALL SELECT query_id, 9, 'passage', {told_sql("'Write a passage that answers the question.' || chr(10) || text")} FROM q),
d AS (SELECT query_id, text, arg_min(kind, place) AS kind, min(place) AS place FROM a GROUP BY query_id, text)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY place) - 1)::INT AS nth, kind, text FROM d""")
def history_expansion(spark, sf_dir):
    """Questions widened in the light of a conversation's first question."""
    first = table(spark, sf_dir, "conversations").filter("role = 'user' AND text IS NOT NULL").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("history"))
    return models.expand_with_history(questions(spark, sf_dir).join(first, "query_id", "left"), models.EchoGenerator())


@query("SELECT DISTINCT sha256(concat_ws(':', 'hash', text)) AS key, 64 AS dimensions FROM documents")
def embedding_cache(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("text")
    embedder = models.HashEmbedder()
    cache = models.embed_with_cache(table(spark, sf_dir, "benchmark").select("text"), spark.createDataFrame([], "key string, embedding array<float>"), embedder, "hash")
    return models.embed_with_cache(docs, cache, embedder, "hash").select("key", F.size("embedding").alias("dimensions"))


@query()
def hybrid_dense_sparse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id"))
    embedder = models.HashEmbedder()
    vectors = models.embed(docs.select(F.col("doc_id").alias("vec_id"), "text"), embedder, "vec_id").withColumn("doc_id", F.col("vec_id"))
    asked = questions(spark, sf_dir)
    return retrieve(docs, vectors, asked, models.embed(asked, embedder, "query_id"), "doc_id", "ord", index=document_index(spark, sf_dir))


@query()
def deep_retrieval(spark, sf_dir):
    docs, index = table(spark, sf_dir, "documents"), document_index(spark, sf_dir)

    def search(texts):
        # Every text is a list of its own; all lists of a question are fused.
        numbered = texts.select("query_id", "text").withColumn("list_id", F.xxhash64("text"))
        asked = numbered.select(F.struct("query_id", "list_id").alias("query_id"), "text")
        lists = bm25.search(index, asked, 24).select("query_id.query_id", "query_id.list_id", "doc_id", "rank")
        return fused_topk(lists, docs.select("doc_id"), "doc_id")

    def widen(texts, pool):
        return models.expand(texts, models.EchoGenerator()).filter("nth > 0").select("query_id", "text")

    return deep_retrieve(search, questions(spark, sf_dir), widen, "doc_id")[0].select("query_id", "doc_id", "score", "position")


@query("SELECT count(*) FILTER (WHERE event_type <> 'error') AS accepted, count(*) FILTER (WHERE event_type = 'error') AS dead FROM events")
def stream_offsets(spark, sf_dir):
    folder = streams.work_folder(spark, "events")
    parse = lambda batch: batch.withColumn("k", F.from_json("props", "k bigint")["k"])
    streams.take_events(streams.file_stream(spark, sf_dir, "events"), folder, (F.col("event_type") == "error") | F.col("user_id").isNull() | F.col("k").isNull(), parse)
    accepted = spark.read.parquet(f"{folder}/accepted").agg(F.count("*").alias("accepted"))
    return accepted.join(spark.read.parquet(f"{folder}/dead").agg(F.count("*").alias("dead")))


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY doc_id")
def stream_incremental(spark, sf_dir):
    corpus = streams.maintain_chunks(streams.file_stream(spark, sf_dir, "documents", 2), streams.work_folder(spark, "chunks"))
    return corpus.groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("SELECT conv_id * 100 + turn AS exchange, length(ltrim(text))::BIGINT AS shown_chars FROM conversations WHERE role = 'assistant' AND ltrim(text) <> ''")
def stream_filter(spark, sf_dir):
    rows = streams.file_stream(spark, sf_dir, "conversations", 1000).filter("role = 'assistant'")
    whole = F.concat(F.lit("<think>about "), F.col("role"), F.lit("</think>"), F.col("text"))
    pieces = rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("exchange"), F.posexplode(F.regexp_extract_all(whole, F.lit("(?s).{1,40}"), F.lit(0))).alias("seq", "piece"))
    folder = streams.work_folder(spark, "shown")
    query = streams.visible_text(pieces).writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("exchange").agg(F.sum(F.length("shown")).alias("shown_chars"))
