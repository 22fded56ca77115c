"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import chat_format, collocations, decontam, fingerprints, lexical_search, license_scan, line_dedup, near_dedup, packing, quality, sharding, substring_dedup, token_counts
from quarrystone.llm.shared import small_batches

#: Where the public tokenizer files lie; a parameter of the operators.
WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file(WORD_TOKENIZER))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
s AS (SELECT doc_id, i, line, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS spaced FROM l),
f AS (SELECT doc_id, i, line, regexp_replace(spaced, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS form FROM s),
w AS (SELECT doc_id, i, line, form, string_split(form, ' ') AS w FROM f WHERE form <> ''),
k AS (SELECT *, concat_ws(' ', len(w)::VARCHAR, array_to_string(w[1:3], ' ')) AS leaf FROM w),
forms AS (SELECT leaf, form, w, count(*) AS n FROM k WHERE leaf IN (SELECT leaf FROM k GROUP BY leaf HAVING count(*) >= 10) GROUP BY leaf, form, w),
tok AS (SELECT leaf, form, n, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM forms),
many AS (SELECT leaf FROM forms GROUP BY leaf HAVING count(*) > 1),
con AS (SELECT leaf, pos, token FROM tok WHERE pos > 3 GROUP BY leaf, pos, token HAVING sum(n) >= 10),
shown AS (SELECT t.leaf, t.form, t.pos, CASE WHEN t.token = '<*>' THEN '<*>' WHEN t.pos <= 3 OR c.token IS NOT NULL OR t.leaf NOT IN (SELECT leaf FROM many) THEN t.token ELSE '<*>' END AS tok
  FROM tok t LEFT JOIN con c ON t.leaf = c.leaf AND t.pos = c.pos AND t.token = c.token),
tem AS (SELECT form, string_agg(tok, ' ' ORDER BY pos) AS template, count(*) AS size, count(*) FILTER (WHERE tok <> '<*>') AS fixed FROM shown GROUP BY leaf, form),
marked AS (SELECT k.doc_id, k.i, t.template FROM k JOIN tem t ON k.form = t.form WHERE t.fixed >= 0.5 * t.size),
rec AS (SELECT template, min(doc_id) AS first FROM marked GROUP BY template HAVING count(DISTINCT doc_id) >= 10),
gone AS (SELECT m.doc_id, m.i FROM marked m JOIN rec r ON m.template = r.template WHERE m.doc_id <> r.first),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(k.text) END AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def shingle_sql(source: str, key: str, size: int = 5) -> str:
    """SQL for the distinct shingles of a table's texts."""
    return rf"""SELECT DISTINCT id, unnest(CASE WHEN len(w) >= {size} THEN list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i+{size - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM (SELECT {key} AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {source})"""


OP4_SQL = f"""
WITH d AS ({shingle_sql("documents", "doc_id")}), b AS ({shingle_sql("benchmark", "item_id")}),
q AS (SELECT id, count(*) AS n FROM b GROUP BY id),
x AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM d JOIN b ON d.s = b.s GROUP BY d.id, b.id)
SELECT doc_id, item_id, n_shared::BIGINT AS n_shared, n::BIGINT AS n_item_shingles, n_shared / n AS containment
FROM x JOIN q ON q.id = x.item_id WHERE 100 * n_shared >= 80 * n
"""


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


OP5_SQL = f"""
WITH RECURSIVE sh AS ({shingle_sql("documents", "doc_id", 3)}), n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
met AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
links AS (SELECT a, b FROM met JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, ways.b FROM reach JOIN ways ON ways.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.id = d.doc_id JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id
"""


#: The control-string conversation that the contract adds.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    formatted = chat_format.format_messages(chat_format.text_messages(rows.unionByName(extra)))
    return chat_format.conversation_digests(formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_chars"))


#: Every turn adds its marks (24 code points), its role and text, and a backslash for each ``<`` in them.
OP6_SQL = rf"""
WITH r AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{CONTROL_TEXT}'), (-1, 1, 'assistant', '{CONTROL_TEXT}'))),
p AS (SELECT conv_id, turn, role || chr(10) || text || chr(10) AS told, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned, 24 + length(replace(role, '<', '<\')) + length(replace(text, '<', '<\')) AS n FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(told, '' ORDER BY turn)) AS turns_sha256, sum(length(learned))::BIGINT AS loss_chars,
  sha256(string_agg(learned, '' ORDER BY turn)) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM p GROUP BY conv_id
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substring_dedup.remove_repeated(table(spark, sf_dir, "documents")).drop("kept_text")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
firsts AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM win JOIN firsts USING (s) WHERE first < doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(gone.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL), '') AS text FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return fingerprints.edited_neighbours(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    lengths = token_counts.token_lengths(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_TOKENIZER), tokenizer_pattern())
    return token_counts.length_histogram(lengths)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return collocations.collocations(table(spark, sf_dir, "documents"), max_words=3, min_count=10, share=50, top=2000)


#: DuckDB SQL for a text with A-Z lower-cased.
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: DuckDB SQL for the words of a lower-cased text where only letters, digits and what is beyond ASCII make words.
WORDS_SQL = rf"list_filter(regexp_split_to_array({LOWER_SQL}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP11_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER_SQL}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, 1 AS k, unnest(w) AS s FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) FROM w),
f AS (SELECT lang, k, s, count(*) AS f FROM g GROUP BY lang, k, s),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, s, f AS a, string_split(s, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, s, a, unnest(range(1, k)) AS cut, w FROM c),
parts AS (SELECT lang, k, s, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut+1:k], ' ') AS y FROM cuts),
scores AS (SELECT parts.lang, parts.k, parts.s, a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM parts JOIN f x ON x.lang = parts.lang AND x.s = parts.x JOIN f y ON y.lang = parts.lang AND y.s = parts.y),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, cut) = 1),
longer AS (SELECT lang, s, max(a) AS around FROM (SELECT lang, array_to_string(w[1:2], ' ') AS s, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY lang, s),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, s) WHERE k = 3 OR coalesce(100 * around < 50 * a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS rank FROM kept)
SELECT lang, rank, s AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lexical_search.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_all FROM d WHERE len(w) > 0),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({WORDS_SQL}) AS term FROM benchmark) GROUP BY item_id, term),
t AS (SELECT place, doc_id, len(w) AS n, unnest(w) AS term FROM d),
p AS (SELECT place, doc_id, n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY place, doc_id, n, term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
shares AS (SELECT place, doc_id, p.term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_all)))) AS share
  FROM p JOIN f ON f.term = p.term CROSS JOIN s),
scores AS (SELECT item_id, doc_id, place, sum(repeats * share)::BIGINT AS score FROM q JOIN shares USING (term) GROUP BY item_id, doc_id, place),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return license_scan.scan(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    phrases = " UNION ALL ".join(f"SELECT {phrase.split(' ')!r} AS p, '{label}' AS label" for phrase, label in license_scan.PHRASES.items())
    matches = ", ".join(f"CASE WHEN regexp_matches(told, '{license_scan.template_pattern(t)}') THEN '{label}' END" for label, t in license_scan.TEMPLATES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, {WORDS_SQL} AS w FROM documents),
phrases AS ({phrases}),
hits AS (SELECT place, label, i - 1 AS pos FROM (SELECT place, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN phrases ON w[i] = p[1] AND w[i:i+len(p)-1] = p),
base AS (SELECT place, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY place),
found AS (SELECT place, list_filter([{matches}], lambda x: x IS NOT NULL) AS labels FROM (SELECT place, ' ' || array_to_string(w, ' ') || ' ' AS told FROM d))
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, found.labels))), ','), '') AS labels,
  CASE WHEN len(found.labels) > 0 THEN 1.0 WHEN n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM d LEFT JOIN base USING (place) JOIN found USING (place)
"""


OP13_SQL = _license_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_packing, op2_quality, op3_line_dedup, op4_decontamination, op5_near_dedup, op6_chat_format, op7_sharding, op8_substring_dedup, op9_fingerprints, op10_token_counts, op11_collocations, op12_lexical_search, op13_license_scan)
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_decontamination": OP4_SQL, "op5_near_dedup": OP5_SQL, "op6_chat_format": OP6_SQL, "op8_substring_dedup": OP8_SQL, "op11_collocations": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_license_scan": OP13_SQL}
