"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document if at least 80 % of its distinct five-word shingles occur there.  Only shingles of some item
matter to that, so each document is first reduced to those it shares with the benchmark; the rest of a long document then neither
costs anything nor dilutes its similarity.  The MinHash search runs on the reduced sets, not on whole documents: it finds which
items a document's shared shingles belong to without pairing it with every item that it has a shingle in common with.

The reduced sets are partitioned by size (powers of two), and in each partition the containment threshold becomes a Jaccard
threshold for an item of q shingles against sets of at most u: ``s = t / (1 + u / q - t)``.  For each partition and item the widest
bands are taken that find a set at that threshold but for the miss probability; where even single positions would miss (items
much smaller than the set), shared shingles are joined, but only an item's rarest: whoever holds the share t of q shingles holds
one of any ``q - ceil(t q) + 1``, so a shingle that all items and documents share pairs nothing unless an item has no other.
Candidates whose set is too small for the item are dropped in the join, and every candidate is verified by exact containment.

Items are looked up by broadcast if their counted shingles and bands are few, else by shuffle joins.

Defined results: null texts, and texts without words, have no shingles: such items are in no document and such documents hold
no item; a text with fewer words than a shingle has its whole sequence as one shingle, so such an item is found only where it is a
whole document; repeated rows with one id are one text set; rows without id are ignored; empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.shared import materialize

SHINGLE = 5
PERCENT = 80
POSITIONS = 128
ROWS = (4, 2)
MISS = 1e-7
#: Up to so many shingles or band keys of the benchmark are broadcast.
BROADCAST_ROWS = 1_000_000


def word_array(text: Column) -> Column:
    """Words between ASCII white space, A-Z in lower case."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column, size: int) -> Column:
    """Distinct hashes of the shingles of a word array; of the whole sequence if it is shorter."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    short = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.when(F.size(words) >= size, runs).otherwise(short))


def shingle_rows(table: DataFrame, id_col: str, size: int) -> DataFrame:
    """(id, shingle) of every text, each once a row of the table."""
    words = table.filter(table[id_col].isNotNull()).select(table[id_col].alias("id"), word_array(table["text"]).alias("words"))
    return words.filter("words IS NOT NULL").select("id", F.explode(shingle_hashes(F.col("words"), size)).alias("shingle"))


def jaccard_bound(q: Column, top: Column, t: float) -> Column:
    """The least Jaccard similarity of a set of at most ``top`` that contains a share t of q elements."""
    return F.lit(t) / (F.lit(1.0) + top / q - F.lit(t))


def band_rows(bound: Column) -> Column:
    """The widest band that finds the bound but for the miss probability; null if none does."""
    out = F.lit(None).cast("int")
    for rows in reversed(ROWS):
        bands = POSITIONS // rows
        least = (1 - MISS ** (1 / bands)) ** (1 / rows)
        out = F.when(bound >= least, F.lit(rows)).otherwise(out)
    return out


def signature(shingles: Column) -> Column:
    """The MinHash positions of a set."""
    return F.transform(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda k: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k))))


def band_keys(minima: Column, rows: int) -> Column:
    """Hashes of the bands of ``rows`` positions of a signature, which must be a stored column."""
    return F.transform(F.sequence(F.lit(0), F.lit(POSITIONS // rows - 1)), lambda b: F.xxhash64(F.lit(rows), b, F.slice(minima, b * rows + 1, rows)))


def log_size(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def rarest_shingles(asked: DataFrame, item_sets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(item_id, shingle): of each item those that the fewest documents hold, as many as a containing document can't all lack."""
    holders = sets.select(F.explode("held").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("holders"))
    ranked = asked.join(holders, "shingle", "left").join(item_sets.select("item_id", "q"), "item_id")
    by = Window.partitionBy("item_id").orderBy(F.coalesce("holders", F.lit(0)), "shingle")  # an item's own shingles
    ranked = ranked.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= F.col("q") - F.ceil(F.col("q") * percent / 100) + 1)
    return ranked.select("item_id", "shingle")


def candidate_pairs(sets: DataFrame, asked: DataFrame, item_sets: DataFrame, percent: int) -> DataFrame:
    """(id, item_id): the documents' reduced sets that the search pairs with an item, each pair once."""
    t = percent / 100
    n_asked = asked.count()
    hint = F.broadcast if n_asked <= BROADCAST_ROWS else lambda table: table
    parts = [r["part"] for r in sets.select("part").distinct().collect()]  # at most 31, powers of two
    # What an item needs in each partition: a band width, or the direct way.
    plans = item_sets.select("item_id", "asked", "minima", "q", F.explode(F.array(*[F.lit(p) for p in parts]).cast("array<int>")).alias("part"))
    plans = plans.withColumn("top", F.pow(F.lit(2.0), F.col("part") + 1) - 1).filter(F.col("top") >= t * F.col("q"))
    plans = plans.withColumn("rows", band_rows(jaccard_bound(F.col("q"), F.greatest("top", F.col("q")), t)))

    n_items, n_parts = item_sets.count(), len(parts)
    enough = F.col("n") * 100 >= F.col("q") * percent
    found = None
    for rows in ROWS:
        keys = plans.filter(F.col("rows") == rows).select("item_id", "q", "part", F.explode(band_keys(F.col("minima"), rows)).alias("band"))
        few = n_items * n_parts * (POSITIONS // rows) <= BROADCAST_ROWS  # an item has a key a band and partition
        held = sets.select("id", "n", "part", F.explode(band_keys(F.col("minima"), rows)).alias("band"))
        pairs = held.join(F.broadcast(keys) if few else keys, ["part", "band"]).filter(enough).select("id", "item_id")
        found = pairs if found is None else found.unionByName(pairs)
    rare = rarest_shingles(asked, item_sets, sets, percent)
    direct = plans.filter("rows IS NULL").select("item_id", "q", "part").join(hint(rare), "item_id")
    direct = F.broadcast(direct) if n_asked * n_parts <= BROADCAST_ROWS else direct  # each shingle in every partition at most
    held = sets.select("id", "n", "part", F.explode("held").alias("shingle"))
    found = found.unionByName(held.join(direct, ["part", "shingle"]).filter(enough).select("id", "item_id"))
    return found.distinct()


def contained_items(docs: DataFrame, items: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item_shingles, containment) of every document that contains an item."""
    asked = materialize(shingle_rows(items, item_col, size).withColumnRenamed("id", "item_id").distinct(), "items")
    hint = F.broadcast if asked.count() <= BROADCAST_ROWS else lambda table: table
    item_sets = asked.groupBy("item_id").agg(F.collect_list("shingle").alias("asked"), F.count("*").alias("q"))  # an item's own shingles
    item_sets = materialize(item_sets.withColumn("minima", signature(F.col("asked"))), "item-sets")

    wanted = asked.select("shingle").distinct()
    shared = shingle_rows(docs, id_col, size).join(hint(wanted), "shingle", "left_semi").distinct()
    sets = shared.groupBy("id").agg(F.collect_list("shingle").alias("held"), F.count("*").alias("n")).withColumn("part", log_size(F.col("n")))
    sets = materialize(sets.withColumn("minima", signature(F.col("held"))), "reduced")
    found = candidate_pairs(sets, asked, item_sets, percent)
    checked = found.join(sets.select("id", "held"), "id").join(hint(item_sets.drop("minima")), "item_id")
    checked = checked.withColumn("n_shared", F.size(F.array_intersect("held", "asked")).cast("bigint")).filter(F.col("n_shared") * 100 >= F.col("q") * percent)
    return checked.select(F.col("id").alias("doc_id"), "item_id", "n_shared", F.col("q").cast("bigint").alias("n_item_shingles"), (F.col("n_shared") / F.col("q")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents that contain no item; columns as they came."""
    bad = materialize(contained_items(docs, items, size, percent).select("doc_id").distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
