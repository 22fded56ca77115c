"""Registered queries of retrieval: statistics, rankings, fusion, context, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.config import Settings
from quarrystone.functions.text import relevance
from quarrystone.operators import bm25, cells, context, dense, fusion
from quarrystone.operators.quality_reports import evaluation
from quarrystone.plans.registry import query, table
from quarrystone.plans.retrieval import retrieve
from quarrystone.plans.text_queries import CHUNKS, fixed

TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def bm25_sql(corpus: str, key: str) -> str:
    """CTEs up to ``scores`` (query_id, key, score) for benchmark passages against a corpus."""
    return rf"""tok AS (SELECT {key}, {TOK} AS t FROM {corpus}), size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT {key}, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT {key}, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY {key}, term),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM size) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf FROM post GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw_idf < 0 THEN (SELECT 0.25 * avg(raw_idf) FROM raw) ELSE raw_idf END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOK}) AS term FROM benchmark) GROUP BY query_id, term),
scores AS (SELECT query_id, {key}, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM size)))) AS score
  FROM asked JOIN terms USING (term) JOIN post USING (term) GROUP BY query_id, {key})"""


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def document_index(spark, sf_dir):
    """BM25 over documents, built once for a version of the table and read by all queries."""
    version = bm25.corpus_version(spark, [f"{sf_dir}/documents.parquet"], kind="documents")
    return bm25.stored_index(table(spark, sf_dir, "documents"), "doc_id", "doc_id", version)


def chunk_index(spark, sf_dir):
    """BM25 over the documents' fixed chunks."""
    version = bm25.corpus_version(spark, [f"{sf_dir}/documents.parquet"], kind="fixed chunks")
    chunks = fixed(spark, sf_dir).withColumn("chunk", F.col("doc_id") * 100_000 + F.col("chunk_index"))
    return bm25.stored_index(chunks, "chunk", "chunk", version, home=("doc_id",))


@query(f"""WITH d AS (SELECT unnest(list_distinct({TOK})) AS term FROM documents), size AS (SELECT count(*) AS n FROM documents), counts AS (SELECT term, count(*) AS df FROM d GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw_idf FROM counts, size)
SELECT term, df, round(CASE WHEN raw_idf < 0 THEN 0.25 * avg(raw_idf) OVER () ELSE raw_idf END, 6) AS idf FROM raw""")
def term_stats(spark, sf_dir):
    return document_index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {bm25_sql('documents', 'doc_id')} SELECT query_id, doc_id, round(score, 6) AS score, rank - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) WHERE rank <= 24")
def bm25_topk(spark, sf_dir):
    found = bm25.search(document_index(spark, sf_dir), questions(spark, sf_dir), 24, zero_fill=False)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {bm25_sql('documents', 'doc_id')}, filled AS (SELECT * FROM scores UNION ALL SELECT q.query_id, d.doc_id, 0.0 FROM (SELECT DISTINCT query_id FROM asked) q, documents d
  WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.query_id = q.query_id AND s.doc_id = d.doc_id))
SELECT query_id, doc_id, round(score, 6) AS score, rank - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM filled) WHERE rank <= 1500""")
def bm25_topk_zero_fill(spark, sf_dir):
    found = bm25.search(document_index(spark, sf_dir), questions(spark, sf_dir), 1500)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


#: Searches take every twentieth vector as a query, against all vectors.
ASKED = "q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0)"
L2 = "list_sum(list_transform(list_zip(qe, embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
COSINE = f"1 - {DOT.format(a='qe', b='embedding')} / (sqrt({DOT.format(a='qe', b='qe')}) * sqrt({DOT.format(a='embedding', b='embedding')}))"


def near_sql(distance: str, k: int) -> str:
    return f"near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) - 1 AS rank FROM (SELECT query_id, vec_id, {distance} AS distance FROM q, embeddings) QUALIFY rank < {k})"


def vector_queries(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_cells(spark, sf_dir, metric):
    """Cells of the vectors, made once for a version of the table and read by all queries."""
    version = bm25.corpus_version(spark, [f"{sf_dir}/embeddings.parquet"], kind="cells")
    return cells.stored_cells(table(spark, sf_dir, "embeddings"), version, metric)


@query(f"WITH {ASKED}, {near_sql(L2, 10)} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM near")
def knn_l2(spark, sf_dir):
    found, _ = cells.nearest_in_cells(vector_cells(spark, sf_dir, "l2sq"), vector_queries(spark, sf_dir), 10)
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {ASKED}, {near_sql(COSINE, 10)} SELECT query_id, vec_id, round(distance, 6) + 0.0::DOUBLE AS distance, rank FROM near")
def knn_cosine_topk(spark, sf_dir):
    found, _ = cells.nearest_in_cells(vector_cells(spark, sf_dir, "cosine"), vector_queries(spark, sf_dir), 10)
    return found.select("query_id", "vec_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {ASKED}, {near_sql(L2, 10)} SELECT query_id, vec_id, round(greatest(0.0, least(1.0, 1 - distance)), 6) AS relevance FROM near")
def relevance_clamp(spark, sf_dir):
    found = dense.nearest(table(spark, sf_dir, "embeddings"), vector_queries(spark, sf_dir), 10)
    return found.select("query_id", "vec_id", F.round(relevance("distance"), 6).alias("relevance"))


@query(f"WITH {ASKED}, {near_sql(L2, 10)} SELECT query_id, count(*) FILTER (WHERE a.label = b.label) AS same_label, max(rank) AS last_rank FROM near n JOIN embeddings a ON n.vec_id = a.vec_id JOIN embeddings b ON n.query_id = b.vec_id GROUP BY query_id")
def knn_label_agreement(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = dense.nearest(e, vector_queries(spark, sf_dir), 10)
    both = found.join(e.select("vec_id", "label"), "vec_id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return both.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("own")).alias("same_label"), F.max("rank").cast("bigint").alias("last_rank"))


#: Two sparse rankings of each question, by documents and by their chunks (best chunk of a document), are fused.
FUSED = rf"""{CHUNKS}, ids AS (SELECT doc_id * 100000 + chunk_index AS ord, doc_id, text FROM chunks), {bm25_sql('ids', 'ord')},
full_scores AS (SELECT query_id, ord // 100000 AS doc_id, score, ord FROM scores),
by_chunk AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM (SELECT query_id, doc_id, max(score) AS score FROM full_scores GROUP BY query_id, doc_id) QUALIFY rank < 24),
by_sum AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM (SELECT query_id, doc_id, sum(score) AS score FROM full_scores GROUP BY query_id, doc_id) QUALIFY rank < 24),
lists AS (SELECT query_id, 0 AS list_id, doc_id, rank FROM by_chunk UNION ALL SELECT query_id, 1, doc_id, rank FROM by_sum),
fused AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (61 + rank)) AS rrf_score, min((list_id, rank)) AS seen FROM lists GROUP BY query_id, doc_id),
best AS (SELECT query_id, doc_id, least(1.0, rrf_score / 0.15) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, seen) AS position FROM fused)"""


def two_rankings(spark, sf_dir):
    """Both lists from one table of scores: its rows count for either, and the best of each are chosen in one pass."""
    scores = bm25.bm25_scores(chunk_index(spark, sf_dir), questions(spark, sf_dir))
    per_doc = scores.groupBy("query_id", "doc_id").agg(F.max("score").alias("top"), F.sum("score").alias("total"))
    both = F.explode(F.array(*[F.struct(F.lit(i).alias("list_id"), F.col(c).alias("score")) for i, c in enumerate(("top", "total"))])).alias("one")
    lists, rows = ("query_id", "list_id"), per_doc.select("query_id", "doc_id", both).select("query_id", "doc_id", "one.*")
    return bm25.ranked(bm25.contenders(rows, 24, "doc_id", lists), 24, "doc_id", lists).select(*lists, "doc_id", "rank")


@query(f"WITH RECURSIVE {FUSED} SELECT query_id, doc_id, round(rrf_score, 6) AS rrf_score FROM fused")
def rrf_fusion(spark, sf_dir):
    return fusion.rrf(two_rankings(spark, sf_dir), "doc_id").select("query_id", "doc_id", F.round("rrf_score", 6).alias("rrf_score"))


def fused_documents(spark, sf_dir, **changes):
    store = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return fusion.fused_topk(two_rankings(spark, sf_dir), store, "doc_id", Settings(**changes), questions(spark, sf_dir).count())


@query(f"WITH RECURSIVE {FUSED} SELECT query_id, doc_id, round(score, 6) AS score, position FROM best WHERE position <= 5")
def hybrid_topk(spark, sf_dir):
    return fused_documents(spark, sf_dir).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("position").cast("bigint").alias("position"))


@query(f"WITH RECURSIVE {FUSED} SELECT query_id, doc_id, round(score, 6) AS score FROM best WHERE score >= 0.2 AND position <= 5")
def min_score_filter(spark, sf_dir):
    return fused_documents(spark, sf_dir, min_score=0.2).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {FUSED}, r AS (SELECT query_id, doc_id, 1.0 / (rank + 1) AS score, list_id AS round FROM lists), m AS (SELECT query_id, doc_id, max(score) AS score FROM r GROUP BY query_id, doc_id), b AS (SELECT m.query_id, m.doc_id, m.score, min(round) AS round FROM m JOIN r ON m.query_id = r.query_id AND m.doc_id = r.doc_id AND m.score = r.score GROUP BY ALL) SELECT query_id, doc_id, round(score, 6)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, round, doc_id) AS position FROM b QUALIFY position <= 20")
def pool_max_merge(spark, sf_dir):
    rounds = two_rankings(spark, sf_dir).select("query_id", "doc_id", (F.lit(1.0) / (F.col("rank") + 1)).alias("score"), F.col("list_id").alias("round"))
    return fusion.merged_pool(rounds, "doc_id", 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("position").cast("bigint").alias("position"))


@query(f"""WITH RECURSIVE {FUSED}, b AS (SELECT query_id, position, '[' || source || ']' || chr(10) || text || chr(10) AS block FROM best JOIN documents USING (doc_id) WHERE position <= 5),
c AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY position) AS total FROM b)
SELECT query_id, position, md5(CASE WHEN total > 8000 THEN substr(block, 1, (8000 - (total - length(block)))::INT) || '...' ELSE block END) AS block, total > 8000 AS truncated FROM c WHERE total <= 8000 OR (8000 - (total - length(block)) > 50)""")
def context_pack(spark, sf_dir):
    found = fused_documents(spark, sf_dir).withColumn("label", F.col("source"))
    packed = context.packed_context(found, Settings(max_context_chars=8000))
    return packed.select("query_id", F.col("position").cast("bigint").alias("position"), F.md5("block").alias("block"), "truncated")


@query(rf"""WITH RECURSIVE {FUSED}, s AS (SELECT query_id, position, i, x AS sentence FROM (SELECT query_id, position, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT query_id, position,
  list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 20) AS l FROM best JOIN documents USING (doc_id) WHERE position <= 5))),
a AS (SELECT item_id AS query_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS told FROM benchmark)
SELECT query_id, position, arg_min(sentence, i) AS citation FROM s JOIN a USING (query_id) WHERE contains(told, lower(trim(regexp_replace(sentence, '\s+', ' ', 'g')))) GROUP BY query_id, position""")
def citations(spark, sf_dir):
    answers = questions(spark, sf_dir).withColumnRenamed("text", "answer")
    found = context.citations(answers, fused_documents(spark, sf_dir))
    return found.select("query_id", F.col("position").cast("bigint").alias("position"), "citation")


@query(f"WITH RECURSIVE {FUSED} SELECT query_id, position, 'doc ' || doc_id AS title, coalesce(nullif(trim(source), ''), 'N/A') AS source, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview, round(score, 2) AS relevance FROM best JOIN documents USING (doc_id) WHERE position <= 5")
def source_cards(spark, sf_dir):
    found = fused_documents(spark, sf_dir).withColumn("title", F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    return context.source_cards(found).withColumn("position", F.col("position").cast("bigint"))


@query(f"""WITH RECURSIVE {FUSED}, r AS (SELECT item_id, count(doc_id) AS hits, coalesce(max(score), 0.0) AS best FROM benchmark LEFT JOIN (SELECT * FROM best WHERE position <= 5 AND score >= 0.21) b ON item_id = query_id GROUP BY item_id)
SELECT count(*) AS total, count(*) FILTER (WHERE hits > 0) AS with_hits, round(count(*) FILTER (WHERE hits > 0) / count(*), 4) AS hit_rate, count(*) FILTER (WHERE hits = 0) AS no_docs, 0::BIGINT AS errors, round(avg(best), 4) AS avg_best_score, round(avg(10.0 * hits), 4)::DOUBLE AS avg_latency_ms FROM r""")
def eval_metrics(spark, sf_dir):
    found = fused_documents(spark, sf_dir, min_score=0.21)
    per = questions(spark, sf_dir).select("query_id").join(found, "query_id", "left").groupBy("query_id").agg(F.count("doc_id").alias("hits"), F.coalesce(F.max("score"), F.lit(0.0)).alias("best_score"))
    # The tables hold no run's latency: ten units a hit stand for it.
    return evaluation(per.withColumn("latency_ms", F.col("hits") * 10.0).withColumn("error", F.lit(None).cast("string")))


#: Questions with the vectors of their ids, against documents with the vectors of theirs: 24 of the dense and 24 of the sparse list.
ZERO_FILLED = """filled AS (SELECT * FROM scores UNION ALL SELECT q.query_id, d.doc_id, 0.0 FROM (SELECT DISTINCT query_id FROM asked) q, documents d
  WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.query_id = q.query_id AND s.doc_id = d.doc_id)),
sparse AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM filled QUALIFY rank < 24)"""
OWN_VECTORS = f"q AS (SELECT item_id AS query_id, embedding AS qe FROM benchmark JOIN embeddings ON vec_id = item_id), {near_sql(L2, 24)}"


def both_sql(lists: str, stage: str) -> str:
    return f"""WITH {bm25_sql('documents', 'doc_id')}, {ZERO_FILLED}, {OWN_VECTORS}, lists AS ({lists}),
fused AS (SELECT query_id, doc_id, sum(1.0::DOUBLE / (61 + rank)) AS rrf_score, min((list_id, rank)) AS seen FROM lists GROUP BY query_id, doc_id),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, seen) AS place FROM fused QUALIFY place <= 24),
best AS (SELECT query_id, p.doc_id, least(1.0, rrf_score / 0.15) AS score, row_number() OVER (PARTITION BY query_id ORDER BY place) AS position FROM pool p JOIN documents d ON d.doc_id = p.doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, position, '{stage}' AS stage FROM best WHERE position <= 5"""


DENSE_LIST = "SELECT query_id, 0 AS list_id, vec_id AS doc_id, rank FROM near"
SPARSE_LIST = "SELECT query_id, 1 AS list_id, doc_id, rank FROM sparse"


def searched(spark, sf_dir, vectors=True, **changes):
    e, asked = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), questions(spark, sf_dir)
    asked_vectors = asked.join(e, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mine = e.withColumn("doc_id", F.col("vec_id"))
    index = document_index(spark, sf_dir) if changes.get("mode") != "dense" else None  # a dense search reads no postings
    found = retrieve(docs, mine if vectors else None, asked, asked_vectors if vectors else None, "doc_id", "doc_id", Settings(**changes), index)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("position").cast("bigint").alias("position"), "stage")


@query(both_sql(f"{DENSE_LIST} UNION ALL {SPARSE_LIST}", "hybrid"))
def hybrid_search(spark, sf_dir):
    return searched(spark, sf_dir)


@query(both_sql(DENSE_LIST, "dense"))
def dense_search(spark, sf_dir):
    return searched(spark, sf_dir, mode="dense")


@query(both_sql(SPARSE_LIST, "sparse"))
def sparse_search(spark, sf_dir):
    return searched(spark, sf_dir, mode="sparse")


@query(both_sql(SPARSE_LIST, "sparse_fallback"))
def sparse_fallback(spark, sf_dir):
    return searched(spark, sf_dir, vectors=False)
