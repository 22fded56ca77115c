"""BM25 Okapi: postings and term statistics as a stored index, and rankings that read only what a query asks for.

Postings are stored as a row a document, with its terms and how often each occurs, and dealt by document (bucketed by its key).  They are counted
within the row, so a build moves texts, once, and never single postings.  All that a query's score of a document needs is in one
bucket: scores are summed and the best of each query chosen where the postings lie, and only those best rows are shuffled.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone import store
from quarrystone.config import Settings
from quarrystone.functions.text import tokens
from quarrystone.session import shared_dir

#: Up to so many query terms are broadcast to the postings; beyond, the join shuffles.
BROADCAST_TERMS = 200_000
#: Up to so many are also named to the scan of stored postings, which then keeps only their rows.
NAMED_TERMS = 5_000
#: About so many postings a bucket: a task holds the scores of its documents for all queries at once, which must fit in its memory.
BUCKET_POSTINGS = 500_000
#: Texts are dealt before their postings are counted: a posting is taken to stand for so many characters.
POSTING_CHARS = 8
#: Changes with the layout of stored indexes: one that other code has written is not read.
LAYOUT = 3
#: One in so many documents tells how good a row of a ranking must be at least.
BOUND_EVERY = 16


@dataclass(frozen=True)
class Index:
    """docs_terms (key, ord, dl, terms, tfs: a row a document; in parts that share no document), terms (term, df, idf), size (n_docs, avgdl: one
    row) and docs (key, ord, dl).

    Documents are dealt by the key or, where they belong to something larger, by that column, their ``home``, which they then have too.
    """

    parts: tuple[DataFrame, ...]
    terms: DataFrame
    size: DataFrame
    docs: DataFrame
    key: str
    home: tuple[str, ...] = ()

    @property
    def postings(self) -> DataFrame:
        return reduce(DataFrame.unionByName, map(exploded, self.parts))

    @staticmethod
    def read(spark: SparkSession, folder: str, key: str, home: tuple[str, ...] = ()) -> Index:
        terms, size, docs = (spark.read.parquet(f"{folder}/{part}") for part in ("terms", "size", "docs"))
        return Index((bucketed(spark, f"{folder}/postings", *(home or (key,))),), terms, size, docs, key, home)


def counted(corpus: DataFrame, key: str, order: str, text: str = "text", home: tuple[str, ...] = ()) -> DataFrame:
    """(home, key, ord, dl, terms, tfs), a row a row of the corpus: its distinct terms, and how often each occurs; dl counts tokens with repeats.

    Words are sorted within the row, by ``sort_array``, as ``array_sort`` calls a function for each comparison; a term begins where a word differs from
    the one before.
    """
    words = corpus.select(*home, F.col(key), F.col(order).alias("ord"), F.sort_array(tokens(text)).alias("words"))
    n = F.size("words")
    begins = F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1)))).otherwise(F.array().cast("array<int>"))
    rows = words.select(*home, key, "ord", n.alias("dl"), "words", begins.alias("begins"))
    tfs = F.transform("begins", lambda at, i: F.coalesce(F.get("begins", i + 1), F.col("dl")) - at)
    return rows.select(*home, key, "ord", F.col("dl").cast("bigint").alias("dl"), F.transform("begins", lambda at: F.get("words", at)).alias("terms"), tfs.alias("tfs"))


def exploded(docs: DataFrame) -> DataFrame:
    """(home, key, ord, term, tf, dl): a row a posting."""
    rest = [c for c in docs.columns if c not in ("terms", "tfs")]
    return docs.select(*rest, "tfs", F.posexplode("terms").alias("_at", "term")).select(*rest, "term", F.get("tfs", F.col("_at")).cast("bigint").alias("tf"))


def one_each(docs: DataFrame, key: str, home: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``counted`` with those of one key made one document; only where there are such is anything but the keys shuffled."""
    ids = [*home, key]
    if docs.groupBy(*ids).count().filter("count > 1").isEmpty():
        return docs
    flat = docs.select(*ids, "ord", "dl", "tfs", F.posexplode_outer("terms").alias("_at", "term")).select(*ids, "ord", "dl", "term", F.get("tfs", F.col("_at")).alias("tf"))
    per = flat.groupBy(*ids, "term").agg(F.min("ord").alias("ord"), F.max("dl").alias("dl"), F.sum("tf").cast("int").alias("tf"))
    told = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("told")  # no row for a document without tokens
    return per.groupBy(*ids).agg(F.min("ord").alias("ord"), F.max("dl").alias("dl"), told).select(*ids, "ord", "dl", F.col("told.term").alias("terms"), F.col("told.tf").alias("tfs"))


def with_idf(counts: DataFrame, size: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(term, df, idf) of (term, df); a negative idf becomes epsilon times the mean raw idf of the vocabulary."""
    s = settings or Settings()
    raw = counts.join(F.broadcast(size.select("n_docs")))  # one row
    raw = raw.withColumn("raw_idf", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).drop("n_docs")
    mean = raw.agg((F.avg("raw_idf") * s.bm25_epsilon).alias("floor_idf"))
    idf = F.when(F.col("raw_idf") < 0, F.col("floor_idf")).otherwise(F.col("raw_idf"))
    return raw.join(F.broadcast(mean)).select("term", "df", idf.alias("idf"))


def term_statistics(posts: DataFrame, size: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(term, df, idf) of postings."""
    return with_idf(posts.groupBy("term").agg(F.count("*").alias("df")), size, settings)


def _table_name(folder: str) -> str:
    return f"postings_{hashlib.md5(folder.encode()).hexdigest()}"


def buckets_for(spark: SparkSession, postings: int) -> int:
    return max(1, -(-postings // BUCKET_POSTINGS), min(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def write_bucketed(docs: DataFrame, key: str, folder: str, buckets: int | None = None, codec: str = "snappy") -> DataFrame:
    """Store rows (key, ord, dl, terms, tfs) by document.

    How many buckets follows from the postings of rows that are stored elsewhere already; with ``buckets`` the rows come dealt by key into as many.
    """
    spark = docs.sparkSession
    if buckets is None:
        buckets = buckets_for(spark, docs.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0])
        docs = docs.repartition(buckets, key)
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(folder)}")
    docs.write.bucketBy(buckets, key).option("path", folder).option("compression", codec).mode("overwrite").saveAsTable(_table_name(folder))
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{folder}-shape")
    return spark.table(_table_name(folder))


def bucketed(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Stored postings as a table that knows its buckets, also in a session that did not write it."""
    name = _table_name(folder)
    if not spark.catalog.tableExists(name):
        buckets = spark.read.parquet(f"{folder}-shape").first()[0]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def write_index(corpus: DataFrame, key: str, order: str, folder: str, settings: Settings | None = None, home: tuple[str, ...] = ()) -> Index:
    """Tokenise the corpus once and store postings by document, term statistics, sizes and the documents' order.

    Texts are dealt by document and counted where they then lie, as a text is smaller than its counted words.  Only where rows share a key are
    all counted and stored first.
    """
    spark, ids, by = corpus.sparkSession, [*home, key], home or (key,)
    rows_of = corpus.groupBy(*ids).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    most, chars = rows_of.agg(F.max("n"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    if (most or 0) > 1:
        counted(corpus, key, order, home=home).write.mode("overwrite").parquet(f"{folder}/counted")
        rows = spark.read.parquet(f"{folder}/counted")
        stored = write_bucketed(one_each(rows, key, home), *by, f"{folder}/postings")
    else:
        buckets = buckets_for(spark, chars // POSTING_CHARS)
        texts = corpus.select(*dict.fromkeys([*ids, order, "text"])).repartition(buckets, *by)
        rows = stored = write_bucketed(counted(texts, key, order, home=home), *by, f"{folder}/postings", buckets)
    rows.select(key, "ord", "dl").write.mode("overwrite").parquet(f"{folder}/docs")  # documents without tokens count
    store.remove(spark, f"{folder}/counted")
    spark.read.parquet(f"{folder}/docs").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{folder}/size")
    term_statistics(stored.select(F.explode("terms").alias("term")), spark.read.parquet(f"{folder}/size"), settings).write.mode("overwrite").parquet(f"{folder}/terms")
    return Index.read(spark, folder, key, home)


def corpus_version(spark: SparkSession, paths: list[str], settings: Settings | None = None, kind: str = "") -> str:
    """A name for the state of the files that a corpus is read from: it changes if one is added, removed or rewritten, or if the
    settings or the layout of the index do.  File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "modificationTime", "length")
    told = files.agg(F.count("*"), F.sum("length"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([*map(str, told), kind, LAYOUT, repr(settings or Settings())]).encode()).hexdigest()[:24]


def stored_index(corpus: DataFrame, key: str, order: str, version: str, settings: Settings | None = None, root: str | None = None, home: tuple[str, ...] = ()) -> Index:
    """The index of this version of the corpus: read if it is complete, else built.

    A build has a folder of its own and is published when it is whole, so readers of older versions and builds of the same one don't disturb
    each other: all sessions read the build that was published first.  An interrupted one is done again.
    """
    spark = corpus.sparkSession
    pointer = f"{root or shared_dir(spark) + '/bm25'}/{version}"
    folder = store.current(spark, pointer)
    if folder is None:
        mine = f"{pointer}/build-{uuid.uuid4().hex}"
        write_index(corpus, key, order, mine, settings, home)
        try:
            store.publish(spark, pointer, mine, after=0)
        except store.Conflict:
            store.remove(spark, mine)
        folder = store.current(spark, pointer)
    return Index.read(spark, folder, key, home)


def asked_terms(queries: DataFrame, terms: DataFrame) -> tuple[DataFrame, list[str] | None]:
    """(query_id, term, times, idf) of the query terms that the index knows, broadcast if they are few, and the terms if they are very few."""
    asked = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    names = [r["term"] for r in asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()] if few else []
    found = (terms.filter(F.col("term").isin(names)) if 0 < len(names) <= NAMED_TERMS else terms).select("term", "idf").join(F.broadcast(asked) if few else asked, "term")
    return (F.broadcast(found) if few else found), names if 0 < len(names) <= NAMED_TERMS else None


def share(settings: Settings | None = None) -> Column:
    """What one posting adds to the score of its document."""
    s = settings or Settings()
    tf = F.col("tf")
    return F.col("times") * F.col("idf") * tf * (s.bm25_k1 + 1) / (tf + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * F.col("dl") / F.col("avgdl")))


def bm25_scores(index: Index, queries: DataFrame, settings: Settings | None = None, within: DataFrame | None = None) -> DataFrame:
    """(query_id, home, key, ord, score) of the documents that share a term; repeated query tokens count again.  ``within`` (key) picks documents.

    Stored parts are grouped by document already, so the sums need no shuffle.
    """
    asked, names = asked_terms(queries, index.terms)
    size = F.broadcast(index.size.select("avgdl"))  # one row

    def summed(docs: DataFrame) -> DataFrame:
        posts = exploded(docs if within is None else docs.join(within, index.key, "left_semi"))
        posts = posts if names is None else posts.filter(F.col("term").isin(names))
        return posts.join(asked, "term").join(size).groupBy("query_id", *index.home, index.key).agg(F.sum(share(settings)).alias("score"), F.first("ord").alias("ord"))

    return reduce(DataFrame.unionByName, map(summed, index.parts))


def ranked(scores: DataFrame, pool: int, order: str, lists: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first ``pool`` of each list by score (to 9 decimals, so that equal texts tie), then ``order``; ranks count from 0.

    The number is filtered before it is shifted, so that the planner limits every partition's rows before it shuffles them.
    """
    by = Window.partitionBy(*lists).orderBy(F.desc(F.round("score", 9)), order)
    return scores.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= pool).withColumn("rank", F.col("rank") - 1)


def contenders(scores: DataFrame, pool: int, key: str, lists: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The rows of ``scores`` that can be among the first ``pool`` of their list, so that a ranking need not sort all.

    Some documents are ranked first; the list's ``pool``-th score among them is one that the ``pool``-th of all cannot stay below, and rows under
    it go.  Nothing is lost, whatever documents these are; a list that has fewer of them keeps all its rows.  The choice by key goes down to
    the stored rows, so only the chosen documents are scored twice.
    """
    some = ranked(scores.filter(F.pmod(F.xxhash64(key), F.lit(BOUND_EVERY)) == 0), pool, key, lists).filter(F.col("rank") == pool - 1)
    least = some.select(*[F.col(c).alias(f"_{c}") for c in lists], F.round("score", 9).alias("_least"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in lists])
    kept = scores.join(F.broadcast(least), same, "left").filter(F.col("_least").isNull() | (F.round("score", 9) >= F.col("_least")))  # a row a list
    return kept.select(*scores.columns)


def search(index: Index, queries: DataFrame, pool: int, zero_fill: bool = True, settings: Settings | None = None) -> DataFrame:
    """(query_id, key, ord, score, rank) from an index.

    With ``zero_fill`` a query that has tokens always gets ``pool`` rows: documents of score 0 follow in corpus order, before those whose score
    is negative.  Only the first rows of the corpus can be needed for that, so nothing else is sorted.  A query without tokens has no ranking.
    """
    key = index.key
    scores = bm25_scores(index, queries, settings)
    best = ranked(contenders(scores, pool, key), pool, "ord")
    if not zero_fill:
        return best
    # A document of the head that has a score is not one of score 0, whether it is among the best or not.
    head = index.docs.select(key, "ord").orderBy("ord").limit(_head(index, scores, pool))
    known = bm25_scores(index, queries, settings, within=F.broadcast(head.select(key))).select("query_id", key)
    asked = queries.filter(F.size(tokens("text")) > 0).select("query_id").distinct()
    fill = asked.join(F.broadcast(head)).join(known, ["query_id", key], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(best.select("query_id", key, "ord", "score").unionByName(fill.select("query_id", key, "ord", "score")), pool, "ord")


def _head(index: Index, scores: DataFrame, pool: int) -> int:
    """How many documents of the corpus, in order, hold all that can fill a ranking up.

    A query needs fewer than ``pool`` of them besides the documents that have a score but no positive one.  No term has a negative weight in
    any but tiny or very uniform corpora; only there these are counted.
    """
    if index.terms.agg(F.min("idf")).first()[0] is None or index.terms.filter("idf < 0").isEmpty():
        return 2 * pool
    per = scores.groupBy("query_id").agg(F.count_if(F.col("score") > 0).alias("up"), F.count("*").alias("n"))
    return pool + (per.filter(F.col("up") < pool).agg(F.max("n")).first()[0] or 0)


def bm25_topk(corpus: DataFrame, queries: DataFrame, pool: int, key: str, order: str, zero_fill: bool = True, settings: Settings | None = None) -> DataFrame:
    """``search`` over a corpus that is indexed for this one plan and not stored."""
    rows = counted(corpus, key, order)
    size = rows.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    docs = one_each(rows, key)
    index = Index((docs,), term_statistics(docs.select(F.explode("terms").alias("term")), size, settings), size, rows.select(key, "ord"), key)
    found = search(index, queries, pool, zero_fill, settings)
    return found.withColumnRenamed("ord", order) if order != "ord" else found
