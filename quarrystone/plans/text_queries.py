"""Registered queries over texts, addresses and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import admission, chunking
from quarrystone.plans.inputs import NOW, TEXTS, texts
from quarrystone.plans.registry import query, table
from quarrystone.streaming.streams import parsed_events

#: Fixed chunks as a recursive query: each row carries where the next window starts.
CHUNKS = r"""w AS (
  SELECT doc_id, text, 0 AS start, substr(text, 1, 500) AS win FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, nxt, substr(text, nxt + 1, 500) FROM (SELECT doc_id, text, start + taken - 50 AS nxt FROM (
    SELECT doc_id, text, start, CASE WHEN start + 500 < length(text) AND greatest(
      CASE WHEN strpos(reverse(win), '.') > 0 THEN length(win) - strpos(reverse(win), '.') ELSE -1 END,
      CASE WHEN strpos(reverse(win), '?') > 0 THEN length(win) - strpos(reverse(win), '?') ELSE -1 END,
      CASE WHEN strpos(reverse(win), '!') > 0 THEN length(win) - strpos(reverse(win), '!') ELSE -1 END) > 250
      THEN greatest(
      CASE WHEN strpos(reverse(win), '.') > 0 THEN length(win) - strpos(reverse(win), '.') ELSE -1 END,
      CASE WHEN strpos(reverse(win), '?') > 0 THEN length(win) - strpos(reverse(win), '?') ELSE -1 END,
      CASE WHEN strpos(reverse(win), '!') > 0 THEN length(win) - strpos(reverse(win), '!') ELSE -1 END) + 1 ELSE 500 END AS taken FROM w)) WHERE nxt < length(text)),
cut AS (SELECT doc_id, start, regexp_replace(substr(win, 1, CASE WHEN start + 500 < length(text) AND m > 250 THEN m + 1 ELSE 500 END), '^\s+|\s+$', '', 'g') AS text FROM (
  SELECT *, greatest(
      CASE WHEN strpos(reverse(win), '.') > 0 THEN length(win) - strpos(reverse(win), '.') ELSE -1 END,
      CASE WHEN strpos(reverse(win), '?') > 0 THEN length(win) - strpos(reverse(win), '?') ELSE -1 END,
      CASE WHEN strpos(reverse(win), '!') > 0 THEN length(win) - strpos(reverse(win), '!') ELSE -1 END) AS m FROM w)),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, start, text FROM cut WHERE length(text) > 50)"""


def fixed(spark, sf_dir):
    from quarrystone.session import prepare

    prepare(spark, 512)
    return chunking.fixed_chunks(table(spark, sf_dir, "documents"))


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_index::INT AS chunk_index, start::INT AS start, text FROM chunks")
def chunk_fixed(spark, sf_dir):
    return fixed(spark, sf_dir)


@query(f"""WITH RECURSIVE {CHUNKS}, {TEXTS} SELECT c.doc_id, c.chunk_index::INT AS chunk_index, md5(path || '_' || chunk_index) AS chunk_id, count(*) OVER (PARTITION BY c.doc_id) AS total_chunks
FROM chunks c JOIN texts t ON c.doc_id = t.doc_id""")
def chunk_ids(spark, sf_dir):
    found = fixed(spark, sf_dir).join(texts(spark, sf_dir).select("doc_id", "path"), "doc_id")
    return chunking.identified(found).select("doc_id", "chunk_index", "chunk_id", "total_chunks")


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, count(*) AS chunks, sum(length(text))::BIGINT AS chars, max(length(text))::BIGINT AS longest FROM chunks GROUP BY doc_id")
def chunk_stats(spark, sf_dir):
    return fixed(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("bigint").alias("longest"))


@query(r"SELECT doc_id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents)")
def tokenize(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(r"SELECT doc_id, CASE WHEN length(c) > 120 THEN rtrim(substr(c, 1, 117)) || '...' ELSE c END AS clipped FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS c FROM documents)")
def clip_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clip("text", 120).alias("clipped"))


#: Stop words of topic keys that occur in the test texts.
STOP_WORDS = ("tion", "that", "this", "with", "from")


@query(r"""SELECT conv_id, turn, CASE WHEN k <> '' THEN k ELSE substr(lower(trim(text)), 1, 80) END AS topic FROM (
  SELECT conv_id, turn, text, array_to_string(list_filter(regexp_extract_all(lower(text), '\p{L}{4,}'), lambda w: w NOT IN ('tion', 'that', 'this', 'with', 'from'))[1:5], ' ') AS k FROM conversations)""")
def gap_key(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.topic_key("text", STOP_WORDS).alias("topic"))


@query(r"""SELECT page_id, h || regexp_replace(regexp_replace(substr(u, length(h) + 1), '/{2,}', '/', 'g'), '/$', '') AS url, regexp_extract(u, '^[^/]*//[^/]*/+([^/]+)', 1) AS space
FROM (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1)) AS h FROM (SELECT page_id, regexp_replace(trim(url), '[?#].*$', '') AS u FROM pages))""")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normal_url("url").alias("url"), T.url_space("url").alias("space"))


@query(r"SELECT page_id, url FROM pages WHERE regexp_extract(url, '^[^/]*//[^/]*/+([^/?#]+)', 1) IN ('en', 'de', 'fr') AND regexp_extract(url, '^[^/]*//[^/]*/+([^/?#]+)', 1) NOT IN ('de')")
def space_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(admission.spaces_kept(F.col("url"), ["en", "de", "fr"], ["de"], [])).select("page_id", "url")


@query(r"""SELECT doc_id, i - 1 AS nth, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 20) AS l FROM documents))""")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("nth", "sentence")).withColumn("nth", F.col("nth").cast("bigint"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


LEXICON = admission.Lexicon(domain_hints=("erchau", "licens"), phrases=("the of", "de la"), greetings=("the", "la", "le", "die", "thon"), off_topic=("edsh", "tionou"))


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(erchau|licens)') THEN 'retrieve'
  WHEN length(q) <= 60 AND n <= 5 AND (regexp_matches(q, '^(the of|de la)[.!? ]*$') OR (regexp_matches(q, '^(the|la|le|die|thon)([ ,.!?]|$)') AND n <= 3)) THEN 'chitchat'
  WHEN length(q) <= 120 AND n <= 14 AND regexp_matches(q, '(edsh|tionou)') THEN 'off_topic' ELSE 'retrieve' END AS route
FROM (SELECT *, CASE WHEN q = '' THEN 0 ELSE len(string_split(q, ' ')) END AS n FROM (SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS q FROM conversations))""")
def query_router(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", admission.route(F.col("text"), LEXICON).alias("route"))


@query("""SELECT conv_id, turn, CASE WHEN length(q) > 1000 THEN 'too_long' WHEN q = '' THEN 'empty' WHEN length(q) < 3 THEN 'too_short' END AS rejected FROM (SELECT conv_id, turn, trim(coalesce(text, '')) AS q FROM conversations)""")
def query_admission(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", admission.admitted(F.col("text"), F.lit(False)).alias("rejected"))


@query("""SELECT event_id, greatest(1, least(50, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 5)))::INT AS top_k, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(value, 0.0)))::DOUBLE AS min_score,
CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'default' END AS answer_mode FROM events""")
def option_clamp(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", admission.clamped_int(k, 5, 1, 50).alias("top_k"), admission.clamped_double(F.col("value"), 0.0, 0.0, 1.0).alias("min_score"), admission.whitelisted(F.col("event_type"), ["view", "click"], "default").alias("answer_mode"))


@query("SELECT event_id, user_id, event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase') AND user_id IS NOT NULL AND props IS NOT NULL")
def event_parse(spark, sf_dir):
    found = parsed_events(table(spark, sf_dir, "events"), ["view", "click", "signup", "purchase"], "props", "k bigint", needed=("user_id",))
    return found.select("event_id", "user_id", "event_type", "k")


@query("SELECT event_id // 1000 AS batch, count(*) AS accepted, max(event_id) + 1 AS next_offset FROM events WHERE event_type <> 'error' GROUP BY 1")
def offset_batch(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    return e.groupBy(F.expr("event_id div 1000").alias("batch")).agg(F.count("*").alias("accepted"), (F.max("event_id") + 1).alias("next_offset"))


@query("""SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first) AS position FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type)""")
def ordered_distinct(spark, sf_dir):
    return admission.ordered_distinct(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id").select("user_id", "event_type", F.col("position").cast("bigint").alias("position"))


@query(f"""WITH e AS (SELECT user_id AS key, min(ts) AS created_at, max(ts) AS last_accessed FROM events GROUP BY user_id)
SELECT key FROM e WHERE created_at + INTERVAL 5 DAY > TIMESTAMP '{NOW}' ORDER BY last_accessed DESC, key LIMIT 100""")
def cache_ttl_lru(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.min(F.col("ts").cast("timestamp_ntz")).alias("created_at"), F.max(F.col("ts").cast("timestamp_ntz")).alias("last_accessed"))
    return admission.cache_survivors(e, F.expr(f"timestamp_ntz'{NOW}'"), 5 * 86_400, 100).select("key")
