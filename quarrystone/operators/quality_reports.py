"""Reports over documents and answers: quality, duplicates, risks, related documents, evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.lines import difference
from quarrystone.functions.text import extension, file_name, folder, strip
from quarrystone.operators.history import all_weak_answers, feedback_summary
from quarrystone.session import checkpoint_dir


def document_quality(files: DataFrame, now: Column, stale_days: int = 180) -> DataFrame:
    """Counts by file type: files, stale (older than so many days) and empty ones."""
    stale = F.col("modified_at") < now - F.make_interval(days=F.lit(stale_days))
    return files.groupBy(extension("path").alias("file_type")).agg(F.count("*").alias("files"), F.count_if(stale).alias("stale"), F.count_if(F.col("size_bytes") == 0).alias("empty"), F.sum("size_bytes").alias("bytes"))


def document_listings(files: DataFrame, now: Column, stale_days: int = 180, limit: int = 10) -> DataFrame:
    """(list, place, path, modified_at): the files changed last, the stale ones from the oldest on, and empty ones by path; ``limit`` of each."""
    stale = files.filter(F.col("modified_at") < now - F.make_interval(days=F.lit(stale_days)))
    kinds = (("recent", files, [F.desc("modified_at"), F.col("path")]), ("stale", stale, [F.col("modified_at"), F.col("path")]), ("empty", files.filter("size_bytes = 0"), [F.col("path")]))
    out = []
    for name, some, order in kinds:
        first = some.select("path", "modified_at").orderBy(*order).limit(limit)  # each task hands on ``limit`` rows
        out.append(first.select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(*order)).alias("place"), "path", "modified_at"))
    return reduce(DataFrame.unionByName, out)


def storage_sizes(files: DataFrame) -> DataFrame:
    """Files and bytes by folder and type."""
    return files.groupBy(folder("path").alias("folder"), extension("path").alias("file_type")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def overview_days(asked: Column | str | int | None, default: int = 30) -> Column:
    """The days that an overview covers: 1 to 365, ``default`` where none or 0 are asked for."""
    days = F.lit(asked) if asked is None or isinstance(asked, int) else F.col(asked) if isinstance(asked, str) else asked
    return F.greatest(F.lit(1), F.least(F.lit(365), F.coalesce(F.nullif(days.cast("int"), F.lit(0)), F.lit(default))))


def duplicate_names(files: DataFrame, limit: int = 10, paths: int = 5) -> DataFrame:
    """File names (without regard to case) that occur more than once, the commonest first, with their first paths.

    Names are counted before anything is shuffled, and only the first paths of the names that are shown are looked up; each task hands on
    ``paths`` of a name at most, however common it is.
    """
    named = files.select(F.lower(file_name("path")).alias("name"), "path")
    shown = named.groupBy("name").agg(F.count("*").alias("files")).filter("files > 1").orderBy(F.desc("files"), "name").limit(limit)
    nth = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    first = named.join(F.broadcast(shown.select("name")), "name", "left_semi").withColumn("nth", nth).filter(F.col("nth") <= paths)
    told = first.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("paths"))
    return shown.join(told, "name").select("name", "files", "paths").orderBy(F.desc("files"), "name")


def risk_summary(feedback: DataFrame, messages: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """One row over the whole tables: votes, weak answers, those with a question (gaps), stale, empty and doubly named files."""
    votes = feedback_summary(feedback).select("up", "down")
    asked = F.trim(F.coalesce("question", F.lit(""))) != ""
    weak = all_weak_answers(messages).agg(F.count("*").alias("weak"), F.count_if(asked).alias("gaps"))
    state = document_quality(files, now).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("stale", "empty")])
    names = duplicate_names(files, limit=1).agg(F.count("*").alias("duplicates"))
    return votes.crossJoin(weak).crossJoin(state).crossJoin(names)


def risk_flags(summary: DataFrame, down_share: float = 0.25) -> DataFrame:
    """Flags over a one-row summary (up, down, weak, gaps, stale, duplicates, empty)."""
    share = F.col("down") / F.greatest(F.col("up") + F.col("down"), F.lit(1))
    flags = F.array(
        F.when(share >= down_share, "high_down_share"),
        F.when(F.col("weak") > 0, "weak_answers"),
        F.when(F.col("gaps") > 0, "knowledge_gaps"),
        F.when(F.col("stale") > 0, "stale_documents"),
        F.when(F.col("duplicates") > 0, "duplicate_names"),
        F.when(F.col("empty") > 0, "empty_documents"),
    )
    return summary.select(F.array_join(F.array_compact(flags), ",").alias("flags"))


def title_words(title: Column) -> Column:
    """Distinct lower-case words of over three characters, dots as spaces."""
    return F.array_distinct(F.filter(F.split(F.replace(F.lower(title), F.lit("."), F.lit(" ")), r"[\s/]+"), lambda w: F.length(w) > 3))


#: A word or folder that makes more pairs than this of classes is common: pairs that share only common ones are scored once a pair of signatures.
COMMON_PAIRS = 10_000


def related_documents(documents: DataFrame, sources: DataFrame, limit: int, common_pairs: int = COMMON_PAIRS) -> DataFrame:
    """For each document its best source: 6 for the same folder, 3 for a path below the source's folder, and up to 4 for shared words between
    the source's title and the document's path; of sources with as many points the first counts.  The best ``limit`` documents.

    What can score is a document's keys (words, folders above it, its own folder) that any source has, and the other way.  Rows with equal keys
    are one class.  Classes meet on rare keys; the common ones, which nearly all have, only make a signature, and signatures meet each
    other once.  So the pairs that are looked at are bounded by those of rare keys and of signatures, not by documents times sources.
    A source is not related to itself, so a class keeps the two best sources that any one source can be missing from.
    """
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    marked = lambda kind, words: F.transform(words, lambda w: F.concat(F.lit(kind), w))
    d = documents.select("path", folder("path").alias("dir"), title_words(F.col("path")).alias("words"))
    d = d.withColumn("keys", F.concat(marked("w:", F.col("words")), F.when(F.col("dir") != "", F.concat(marked("a:", above), F.array(F.concat(F.lit("s:"), "dir")))).otherwise(F.array().cast("array<string>"))))
    s = sources.select("path", "nth", folder("path").alias("dir"), title_words(F.col("title")).alias("words"))
    s = s.withColumn("keys", F.concat(marked("w:", F.col("words")), F.array(F.concat(F.lit("a:"), "dir"), F.concat(F.lit("s:"), "dir"))))

    def classes(rows: DataFrame, others: DataFrame, *more: Column) -> DataFrame:
        """(class, keys, members' columns): rows by the keys that the other side has too."""
        known = others.select(F.explode("keys").alias("key")).distinct()
        held = rows.select("path", F.explode("keys").alias("key")).join(known, "key").groupBy("path").agg(F.array_sort(F.collect_set("key")).alias("held"))
        return rows.join(held, "path").select("path", *more, "held", F.md5(F.array_join("held", "\n")).alias("class"))

    spark = documents.sparkSession
    checkpoint_dir(spark)
    d = classes(d, s).checkpoint()
    s = classes(s, d.withColumnRenamed("held", "keys"), F.col("nth")).checkpoint()
    kinds = [rows.groupBy("class").agg(F.first("held").alias("held")) for rows in (d, s)]
    keyed = [rows.select("class", F.explode("held").alias("key")) for rows in kinds]
    n = [rows.groupBy("key").agg(F.count("*").alias(name)) for rows, name in zip(keyed, ("x", "y"), strict=True)]
    common = n[0].join(n[1], "key").filter(F.col("x") * F.col("y") > common_pairs).select("key").checkpoint()

    def signed(rows: DataFrame) -> DataFrame:
        """Classes with their signature: the common keys they have."""
        hot = rows.select("class", F.explode("held").alias("key")).join(common, "key", "left_semi").groupBy("class").agg(F.array_sort(F.collect_list("key")).alias("common"))
        return rows.join(hot, "class", "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))

    dc, sc = (signed(rows).checkpoint() for rows in kinds)

    def points(shared: Column) -> Column:
        n = lambda kind: F.size(F.filter(shared, lambda k: k.startswith(kind)))
        return F.least(n("w:"), F.lit(4)) + 3 * F.least(n("a:"), F.lit(1)) + 6 * F.least(n("s:"), F.lit(1))

    # The two first sources of a class, and of a signature: one of them is not the document itself.
    two = lambda rows, key: rows.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("nth", "path"))), 1, 2).alias("first"))
    numbered = s.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("nth"))).filter("place <= 2")
    firsts = two(numbered, "class")
    by_sign = numbered.join(sc.select("class", "common"), "class").withColumn("place", F.row_number().over(Window.partitionBy("common").orderBy("nth"))).filter("place <= 2")
    sign_firsts = two(by_sign, "common")
    rare = [rows.select("class", F.explode("held").alias("key")).join(common, "key", "left_anti") for rows in (dc, sc)]
    meets = rare[0].withColumnRenamed("class", "dclass").join(rare[1].withColumnRenamed("class", "sclass"), "key").select("dclass", "sclass").distinct()
    met = meets.join(dc.select(F.col("class").alias("dclass"), F.col("held").alias("dheld")), "dclass").join(sc.select(F.col("class").alias("sclass"), F.col("held").alias("sheld")), "sclass")
    met = met.select("dclass", points(F.array_intersect("dheld", "sheld")).alias("points"), "sclass").filter("points > 0").join(firsts.withColumnRenamed("class", "sclass"), "sclass").select("dclass", "points", "first")
    signs = dc.select(F.col("common").alias("dsign")).filter(F.size("common") > 0).distinct().join(sign_firsts.withColumnRenamed("common", "ssign"), F.arrays_overlap("dsign", "ssign"))
    signs = signs.select("dsign", points(F.array_intersect("dsign", "ssign")).alias("points"), "first").filter("points > 0")
    over = dc.select(F.col("class").alias("dclass"), F.col("common").alias("dsign")).join(signs, "dsign").select("dclass", "points", "first")
    one = met.unionByName(over).select("dclass", "points", F.explode("first").alias("source")).groupBy("dclass", "source").agg(F.max("points").alias("points"))
    order = F.struct((-F.col("points")).alias("down"), F.col("source.nth").alias("nth"), F.col("source.path").alias("path"))
    best = one.withColumn("order", order).withColumn("place", F.row_number().over(Window.partitionBy("dclass").orderBy("order"))).filter("place <= 2")
    best = best.groupBy("dclass").agg(F.array_sort(F.collect_list("order")).alias("best"))
    told = d.join(best, d["class"] == best["dclass"]).withColumn("source", F.filter("best", lambda b: b["path"] != F.col("path"))[0]).filter("source IS NOT NULL")
    return told.select("path", F.col("source.path").alias("source_path"), (-F.col("source.down")).cast("bigint").alias("points")).orderBy(F.desc("points"), "path").limit(limit)


def version_diff(pairs: DataFrame, shown: int = 8) -> DataFrame:
    """(path, ratio, added, removed, first added and removed lines) of two versions' stripped non-blank lines."""

    def diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, old, new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ratio, come, gone = difference(old, new)
                rows.append((path, round(ratio, 3), len(come), len(gone), come[:shown], gone[:shown]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            texts = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.int64(), pa.int64(), texts, texts), strict=True)], names=["path", "ratio", "n_added", "n_removed", "added", "removed"])

    return pairs.select("path", "old", "new").mapInArrow(diff, "path string, ratio double, n_added bigint, n_removed bigint, added array<string>, removed array<string>")


def line_changes(pairs: DataFrame) -> DataFrame:
    """(path, n_lines, n_added, n_removed) without regard to order: by how many lines, equal ones counted each, either version has more."""
    lines = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"), strip), lambda x: x != "")
    sides = [pairs.select("path", F.explode(lines(c)).alias("line"), F.lit(n).alias("n")) for c, n in (("old", -1), ("new", 1))]
    per_line = sides[0].unionByName(sides[1]).groupBy("path", F.sha2("line", 256).alias("line")).agg(F.sum("n").alias("more"), F.count("*").alias("lines"))
    told = per_line.groupBy("path").agg(F.sum("lines").alias("n_lines"), F.sum(F.greatest("more", F.lit(0))).alias("n_added"), F.sum(F.greatest(-F.col("more"), F.lit(0))).alias("n_removed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pairs.select("path").join(told, "path", "left").select("path", zero("n_lines"), zero("n_added"), zero("n_removed"))


def evaluation(results: DataFrame) -> DataFrame:
    """One row over a basket's runs (query_id, hits, best_score, latency_ms, error)."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("hits") > 0).alias("with_hits"),
        F.round(F.count_if(F.col("hits") > 0) / F.count("*"), 4).alias("hit_rate"),
        F.count_if((F.col("hits") == 0) & F.col("error").isNull()).alias("no_docs"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.round(F.avg("best_score"), 4).alias("avg_best_score"),
        F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"),
    )
