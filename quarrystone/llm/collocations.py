"""Phrase collocation mining by hierarchical pair naming.

Texts become blocks: runs of words with breaks between pieces, each block with its own small numbering of what it holds.  A level
counts the block's distinct grams, sums them over all blocks and names each that is frequent enough by the least place where it
stands; the names go back to the blocks.  Two adjacent named grams of k-1 words then make a gram of k words, whose two names are its
parent pointers: they lead to the counts of all its beginnings and ends, for the cuts, and to the phrases it contains, for
subsumption.  Only distinct grams of a block are shuffled, never places, so a phrase that is everywhere costs a row a block.

Defined results: null texts are empty, a null language is ``und``; empty texts have no words; repeated rows count each; an empty table
gives no rows; further columns, whatever their names, are ignored.  A language with fewer than ``top`` phrases gives all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.shared import discard, materialize

#: Bytes of text of a block: what one task holds at a time, besides the rest of a piece.
BLOCK_BYTES = 10_000_000
#: A place is block * 2^31 + number in the block; a block is partition * 4,096 + number in the partition.
PLACE, BLOCKS_EACH = 31, 4096
#: Rows of a language that one task ranks.
RANKED_ROWS = 50_000
#: Rows of an Arrow batch that leaves a task.
OUT_ROWS = 65_536

#: A-Z to a-z, and the marks that end a piece to a byte that UTF-8 never holds.  All other bytes stay, so code points stay whole.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes.maketrans(bytes(range(65, 91)) + _ENDS, bytes(range(97, 123)) + b"\xff" * len(_ENDS))


class Numbering(dict):
    """Numbers of words, given at first sight from a count that several numberings share; 0 is a break."""

    def __init__(self, given: list):
        super().__init__({b"\xff": 0})
        self.given = given

    def __missing__(self, word: bytes) -> int:
        self.given[0] += 1
        self[word] = self.given[0]
        return self.given[0]


def _packed(numbers: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<i4").tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")


def _joined_breaks(numbers: np.ndarray) -> np.ndarray:
    """Without breaks that follow a break."""
    keep = numbers != 0
    keep[1:] |= numbers[:-1] != 0
    return numbers[keep]


WORDS = "place bigint, lang string, word string, n bigint, block bigint, seq binary"
_WORDS = pa.schema([("place", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("seq", pa.binary())])
PAIRS = "place bigint, a bigint, b bigint, n bigint, block bigint, seq binary"
_PAIRS = pa.schema([("place", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("block", pa.int64()), ("seq", pa.binary())])


def _block_rows(schema: pa.Schema, block: int, columns: dict, seq: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A row for each gram of a block, then one with its sequence, if there is one."""
    rows = pa.table(columns | {"block": pa.nulls(len(columns["n"]), pa.int64()), "seq": pa.nulls(len(columns["n"]), pa.binary())}, schema=schema)
    yield from rows.to_batches(OUT_ROWS)
    if seq is not None:
        yield pa.RecordBatch.from_pylist([{"block": block, "seq": _packed(seq)}], schema=schema)


def word_blocks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Distinct words of each block with their counts, and each block's sequence of word numbers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, made = TaskContext.get().partitionId(), 0
        given, numberings, parts, held = [0], {}, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal given, numberings, parts, held, made
            if made == BLOCKS_EACH:
                raise ValueError(f"a partition of over {BLOCKS_EACH} blocks: read it in more partitions")
            seq = _joined_breaks(np.concatenate(parts))
            counts = np.bincount(seq, minlength=given[0] + 1)
            block = partition * BLOCKS_EACH + made
            langs, words, numbers = [], [], []
            for lang, numbering in numberings.items():
                del numbering[b"\xff"]
                langs += [lang] * len(numbering)
                words += numbering.keys()
                numbers += numbering.values()
            numbers = np.array(numbers, np.int64)
            texts = pa.array(words, pa.binary()).cast(pa.string())
            columns = {"place": (block << PLACE) + numbers, "lang": pa.array(langs, pa.string()), "word": texts, "n": counts[numbers].astype(np.int64)}
            yield from _block_rows(_WORDS, block, columns, seq)
            given, numberings, parts, held, made = [0], {}, [], 0, made + 1

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                data = data.translate(_LOWER)
                at = 0
                while at < len(data):
                    end = at + block_bytes - held
                    cut = len(data) if end >= len(data) else data.find(b"\xff", max(end, at))  # blocks end where pieces do
                    cut = len(data) if cut < 0 else cut
                    if lang not in numberings:
                        numberings[lang] = Numbering(given)
                    part = data[at:cut].replace(b"\xff", b" \xff ").split()
                    parts.append(np.array([*map(numberings[lang].__getitem__, part), 0], np.int32))
                    held += cut - at
                    at = cut + 1
                    if held >= block_bytes:
                        yield from close()
        if parts:
            yield from close()

    return docs.select(docs[text_col].alias("text"), F.coalesce(docs[lang_col], F.lit("und")).alias("lang")).mapInArrow(read, WORDS)


def named(grams: DataFrame, key: list[str], min_count: int) -> DataFrame:
    """Rows of frequent grams: their place, their global name (the least place) and, in the row that stands there, key and count."""
    same = Window.partitionBy(*key)
    counted = grams.filter("place IS NOT NULL").select("place", *key, F.sum("n").over(same).alias("f"), F.min("place").over(same).alias("id")).filter(F.col("f") >= min_count)
    once = F.col("place") == F.col("id")
    return counted.select("place", "id", *[F.when(once, F.col(c)).alias(c) for c in [*key, "f"]])


def pair_blocks(grams: DataFrame, names: DataFrame, last: bool = False) -> DataFrame:
    """The next level: distinct pairs of adjacent named grams of each block, and, but for the last level, each block's sequence of pair numbers."""

    def pair(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _PAIRS.empty_table()
        seq = _unpacked(left.column("seq")[0].as_py())
        numbers = right.column("place").to_numpy() & ((1 << PLACE) - 1)
        ids = np.zeros(max(seq.max(initial=0), numbers.max(initial=0)) + 1, np.int64)
        known = np.zeros(len(ids), bool)
        ids[numbers], known[numbers] = right.column("id").to_numpy(), True
        there = known[seq]
        both = there[:-1] & there[1:]
        held, which, counts = np.unique((seq[:-1][both].astype(np.int64) << 32) | seq[1:][both], return_inverse=True, return_counts=True)
        after = np.zeros(len(both), np.int32)
        after[both] = which + 1
        block = key[0].as_py()
        columns = {"place": (block << PLACE) + np.arange(1, len(held) + 1), "a": ids[held >> 32], "b": ids[held & 0xFFFFFFFF], "n": counts.astype(np.int64)}
        return pa.Table.from_batches(_block_rows(_PAIRS, block, columns, None if last else _joined_breaks(after)), _PAIRS)

    sequences = grams.filter("seq IS NOT NULL").select("block", "seq")
    back = names.select(F.shiftright("place", PLACE).alias("block"), "place", "id")
    return sequences.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(pair, PAIRS)


def phrase_levels(docs: DataFrame, max_words: int, min_count: int, block_bytes: int = BLOCK_BYTES) -> tuple[list[DataFrame], DataFrame]:
    """Frequent grams by length, and the number of words of each language.

    A gram has its id, parents a and b (its first and last k-1 words; none for words), lang, phrase, f, and f of its beginnings
    (``heads``) and ends (``tails``) by length, its own last.
    """
    blocks = materialize(word_blocks(docs, block_bytes=block_bytes), "words", "zstd")
    totals = materialize(blocks.filter("place IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    names = materialize(named(blocks, ["lang", "word"], min_count), "names")
    own = F.array("f")
    none = F.lit(None).cast("bigint")
    levels = [materialize(names.filter("f IS NOT NULL").select("id", none.alias("a"), none.alias("b"), "lang", F.col("word").alias("phrase"), "f", own.alias("heads"), own.alias("tails")), "grams")]
    for n_words in range(2, max_words + 1):
        pairs = materialize(pair_blocks(blocks, names, n_words == max_words), "pairs", "zstd")
        discard(blocks, names)
        if n_words == max_words:  # no block needs these names
            grams = pairs.groupBy("a", "b").agg(F.sum("n").alias("f"), F.min("place").alias("id")).filter(F.col("f") >= min_count)
        else:
            names = materialize(named(pairs, ["a", "b"], min_count), "names")
            grams = names.filter("f IS NOT NULL").select("id", "a", "b", "f")
        first = levels[-1].select(F.col("id").alias("a"), "lang", F.col("phrase").alias("begin"), "heads")
        last = levels[-1].select(F.col("id").alias("b"), F.substring_index("phrase", " ", -1).alias("end"), "tails")
        grams = grams.join(first, "a").join(last, "b").withColumn("phrase", F.concat_ws(" ", "begin", "end"))
        levels.append(materialize(grams.select("id", "a", "b", "lang", "phrase", "f", F.concat("heads", own).alias("heads"), F.concat("tails", own).alias("tails")), "grams"))
        blocks = pairs
    discard(blocks, names)
    return levels, totals


def scored(gram: DataFrame, n_words: int) -> DataFrame:
    """The lowest-scoring cut of phrases of ``n_words``: a, l, r and floor(1000000 * a * a / (l * r)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")

    def cut(k: int):
        left, right = F.element_at("heads", k), F.element_at("tails", n_words - k)
        above = (wide(F.col("f")) * wide(F.col("f"))).cast("decimal(38,0)")
        # 1000000 * a * a could pass 38 digits for counts over 10^16; a count that large needs more words than any table has.
        score = F.call_function("div", (above * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))
        return F.struct(score.cast("bigint").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    lowest = F.array_min(F.array(*[cut(k) for k in range(1, n_words)]))
    return gram.select("id", "lang", "phrase", F.col("f").alias("a"), lowest.alias("cut")).select("id", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def best_of_each(rows: DataFrame, key: str, order: list, top: int, rows_each: int = RANKED_ROWS) -> DataFrame:
    """The first ``top`` rows of each key with their rank, by rounds: tasks rank a bounded share of a key's rows each, until one can rank all."""
    most = rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    while most > rows_each:
        shares = -(-most // rows_each)
        if shares * top >= most:
            break
        place = Window.partitionBy(key, "share").orderBy(*order)
        dealt = rows.withColumn("share", F.pmod(F.xxhash64(*rows.columns), F.lit(shares)))
        rows, most = dealt.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top).drop("share", "rank"), shares * top
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, share: int = 50, top: int = 2000, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The best phrases of 2 to ``max_words`` words of each language.

    Dropped are phrases that a longer one of at least ``share`` hundredths of their count contains; the next longer ones decide, as
    any phrase between the two has at least the count of the longer.
    """
    levels, totals = phrase_levels(docs, max_words, min_count, block_bytes)
    found = []
    for n_words, level in enumerate(levels[1:], 2):
        rows = scored(level, n_words)
        if n_words < max_words:
            longer = levels[n_words]
            around = longer.select(F.col("a").alias("id"), "f").unionByName(longer.select(F.col("b").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("around"))
            rows = rows.join(around, "id", "left").filter((100 * F.coalesce("around", F.lit(0)) < share * F.col("a"))).drop("around")
        found.append(rows)
    rows = materialize(reduce(DataFrame.unionByName, found).drop("id"), "phrases")
    ranked = best_of_each(rows, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
