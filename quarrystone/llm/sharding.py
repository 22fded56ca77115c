"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id), so that equal texts lie side by side.  Splitters between shards are found
without sorting: exact bytes are counted in cells of the key space (probes at the cells' borders), and only the cells in which
a target falls are refined by the next digit of the key, again and again, until the bytes below each splitter meet the
tolerance or the key has no digits left.  Equal texts stay together, on the side of the border that is nearer, unless their rows
hold more than ``SPLIT_SHARE`` of a shard: only then are they refined by the hash of their doc_ids, so that a third of all rows
with one text is split as exactly as anything else.  One exchange follows.

A round is one grouped sum over (key, size); the driver sees at most ``CELLS`` rows a splitter and round, whatever the input.

Law ``bytes``: a border is off its target by less than the tolerance, or by half of a text's rows that stay together (at most
``SPLIT_SHARE`` / 2 of a shard, or half of a single larger row).

Defined results: a null text has no bytes and counts its overhead only; repeated rows are placed once each, in any order among
themselves; a null doc_id is a key like any other; an empty table gives no rows; extra columns are kept, but
for those that bear an added column's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.shared import discard, materialize, rows_per_bucket, with_prefix_counts

SHARDS = 24
OVERHEAD = 8
BITS = 8
CELLS = 1 << BITS
DIGITS = 16
TOLERANCE = 0.001
#: Rows of one text are split only if they hold more than this share of a shard.
SPLIT_SHARE = 0.1
#: About so many rows make a range in which slots are numbered; a range of over twice as many is dealt.
RANGE_ROWS = 20_000
#: Up to so many dealt ranges are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000


def digit(level: int) -> Column:
    """The digit of the key at a level: eight from the hash of the text, eight from that of the doc_id."""
    word = F.col("text_key") if level < DIGITS // 2 else F.col("id_key")
    return F.shiftrightunsigned(word, 64 - BITS * (level % (DIGITS // 2) + 1)).bitwiseAND(F.lit(CELLS - 1)).cast("int")


def find_splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, ...]]:
    """Key prefixes, one a splitter: rows whose digits come before it lie below.

    ``keys`` has text_key, id_key and size.  Each round counts exactly the rows in the cells under every open prefix.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    targets = [total * i / shards for i in range(1, shards)]
    done: dict[int, tuple[int, ...]] = {}
    open_: dict[int, tuple[tuple[int, ...], int]] = {i: ((), 0) for i in range(len(targets))}
    for level in range(DIGITS):
        prefixes = sorted({prefix for prefix, _ in open_.values()})
        if not prefixes or not total:
            break
        path = F.array(*[digit(k) for k in range(level)]) if level else F.array().cast("array<int>")
        here = F.concat_ws(",", path.cast("array<string>"))
        wanted = [",".join(map(str, p)) for p in prefixes]  # at most one a splitter
        rows = keys.select(here.alias("prefix"), digit(level).alias("cell"), "size").filter(F.col("prefix").isin(wanted)).groupBy("prefix", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        cells: dict[tuple[int, ...], dict[int, tuple[int, int]]] = {p: {} for p in prefixes}
        for r in rows:
            cells[tuple(map(int, r["prefix"].split(","))) if r["prefix"] else ()][r["cell"]] = r["bytes"], r["n"]
        for i, (prefix, below) in list(open_.items()):
            for cell in range(CELLS):
                inside, n = cells[prefix].get(cell, (0, 0))
                if below + inside >= targets[i]:
                    break
                below += inside
            # The border before or behind the cell, whichever is nearer; else go on inside, unless one row or one text fills the cell.
            near, at = min((abs(below - targets[i]), cell), (abs(below + inside - targets[i]), cell + 1))
            whole_text = level == DIGITS // 2 - 1 and inside <= SPLIT_SHARE * total / shards
            if near <= tolerance * total / shards or n == 1 or whole_text or level == DIGITS - 1:
                done[i] = (*prefix, at)
                del open_[i]
            else:
                open_[i] = ((*prefix, cell), below)
    return [done.get(i, ()) for i in range(len(targets))]


def before(splitter: tuple[int, ...]) -> Column:
    """Whether a row's key lies below a splitter (whose last digit may be one past the largest)."""
    if not splitter:
        return F.lit(False)
    *path, last = splitter
    out = digit(len(path)) < last
    for level in reversed(range(len(path))):
        out = (digit(level) < path[level]) | ((digit(level) == path[level]) & out)
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus size, text_crc32, shard and slot (gapless from 0 in each shard, in key order).

    Slots come from counts of small ranges of each shard: rows are numbered within a range only, and a range that one text
    fills is dealt over doc_id hashes first.
    """
    text, ident = docs[text_col], docs[id_col].cast("string")
    own = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    base = docs.select(
        own,
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        F.xxhash64(ident).alias("id_key"),
    )
    keys = materialize(base.select("text_key", "id_key", "size"), "shard-keys")
    splitters = find_splitters(keys, shards, tolerance)
    shard = F.lit(0)
    for splitter in splitters:
        shard = shard + F.when(before(splitter), 0).otherwise(1)
    # Number ranges: a prefix of the text hash long enough for about RANGE_ROWS rows, and a hash of the id where a range holds more.
    bits = max(1, min(40, rows_per_bucket(keys.count(), RANGE_ROWS).bit_length()))
    cell = F.shiftrightunsigned("text_key", 64 - bits)
    placed = keys.withColumn("shard", shard.cast("int")).withColumn("cell", cell)
    heavy = placed.groupBy("shard", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * RANGE_ROWS)
    heavy = materialize(heavy.select("shard", "cell", F.ceil(F.col("n") / (2 * RANGE_ROWS)).alias("ways")), "heavy-ranges")
    known = F.broadcast(heavy) if heavy.count() <= BROADCAST_ROWS else heavy

    def dealt(rows: DataFrame) -> DataFrame:
        deal = F.floor(F.shiftrightunsigned("id_key", 32) * F.coalesce("ways", F.lit(1)) / (1 << 32)).cast("int")
        return rows.join(known, ["shard", "cell"], "left").withColumn("deal", deal).drop("ways")

    placed = dealt(placed)
    counts = placed.groupBy("shard", "cell", "deal").agg(F.count("*").alias("n"))
    counts = with_prefix_counts(counts.withColumn("at", F.struct("cell", "deal")), ["shard"], "at", "n", "first").select("shard", "cell", "deal", "first")
    counts = materialize(counts, "shard-counts")
    discard(keys)
    rows = dealt(base.withColumn("shard", shard.cast("int")).withColumn("cell", cell))
    order = Window.partitionBy("shard", "cell", "deal").orderBy("text_key", "id_key")
    rows = rows.withColumn("nth", F.row_number().over(order)).join(counts, ["shard", "cell", "deal"])
    added = {"size", "text_crc32", "shard", "slot"}
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added], "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).cast("bigint").alias("slot"))
