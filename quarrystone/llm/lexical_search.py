"""Ranked lexical search by windowed bucket scoring.

Documents are read once for a block of queries and keep only the postings of its terms.  Ranges of doc_ids are then scored in windows
of a fixed number of documents: a window's postings are turned to lists by term, each query adds its terms' shares into one
array of the window's size, a bitset tells which places were touched, and these are harvested into a heap of the query's best.  A task
hands on its heaps only, so what is shuffled last is ``top`` rows a query and task.

Term statistics come from all documents: how many hold a term, how many have one at all, and the sum of lengths.

Defined results: null and empty texts have no terms and are neither ranked nor counted; rows that share a doc_id are documents of their own,
rows without one come after equal scores; rows that share an item_id are one query, and a null item_id is one too; an item without terms
or matches gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.shared import discard, materialize

#: Documents of a window: its array of scores is 32 KB.
WINDOW = 4096
#: A window ends early when its postings take as much, as those of many long documents do.
WINDOW_BYTES = 32_000_000
#: Rows (query, term) of a block of queries, about: what the driver reads and hands to every task at a time.
BLOCK_TERMS = 50_000

#: A-Z to a-z, and every other ASCII character but letters and digits to a space.  All bytes above stay, so code points stay whole.
_LETTERS = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123))
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _LETTERS else 32 for b in range(256))


def terms_of(text: pa.StringScalar) -> list[bytes]:
    return text.as_buffer().to_pybytes().translate(_TERMS).split() if text.is_valid else []


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, n): the terms of each item and how often it holds them."""
    kind = items.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column(1)):
                held = Counter(terms_of(text))
                columns = [batch.column(0).take(pa.array([at] * len(held), pa.int64())), pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "term", "n"])

    rows = items.select(items[id_col].alias("item_id"), items[text_col].alias("text")).mapInArrow(read, f"item_id {kind}, term string, n bigint")
    return rows.groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs): of every document with terms their number, and the postings of the vocabulary's as int32 arrays."""
    kind = docs.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            rows, lengths, terms, tfs = [], [], [], []
            for at, text in enumerate(batch.column(1)):
                words = terms_of(text)
                if words:
                    held = [(number[t], c) for t, c in Counter(words).items() if t in number]
                    rows.append(at)
                    lengths.append(len(words))
                    terms.append(np.array([t for t, _ in held], "<i4").tobytes())
                    tfs.append(np.array([c for _, c in held], "<i4").tobytes())
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(read, f"doc_id {kind}, n bigint, terms binary, tfs binary")


def document_counts(held: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term; every task counts for itself first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_terms, np.int64)
        for batch in batches:
            for data in batch.column(0):
                counts[np.frombuffer(data.as_buffer(), "<i4")] += 1  # a document holds a term's number once
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], names=["term", "df"])

    df = np.zeros(n_terms, np.int64)
    for row in held.select("terms").mapInArrow(count, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[row["term"]] = row["df"]
    return df


class WindowScores:
    """One window's postings by term, and the score arrays that all queries use in turn."""

    def __init__(self, lengths: np.ndarray, terms: list[bytes], tfs: list[bytes], weights: np.ndarray, n_docs: int, n_all: int):
        sizes = [len(t) // 4 for t in terms]
        term, tf = np.frombuffer(b"".join(terms), "<i4"), np.frombuffer(b"".join(tfs), "<i4").astype(np.int64)
        slot = np.repeat(np.arange(len(sizes)), sizes)
        if lengths.max(initial=0) * n_docs < 1 << 58:
            m = 75 + 25 * lengths * n_docs // n_all
        else:  # the product passes 64 bits, the quotient doesn't
            m = np.array([75 + 25 * int(n) * n_docs // n_all for n in lengths], np.int64)
        share = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[slot]))
        order = np.argsort(term, kind="stable")
        self.slot, self.share, term = slot[order], share[order], term[order]
        held, starts = np.unique(term, return_index=True)
        self.bounds = {t: (a, b) for t, a, b in zip(held.tolist(), starts.tolist(), np.append(starts, len(term))[1:].tolist(), strict=True)}
        self.size = len(sizes)
        self.scores = np.zeros(self.size, np.int64)
        self.bits: dict[int, np.ndarray] = {}

    def touched(self, term: int) -> np.ndarray:
        """The bitset of the documents that hold a term."""
        if term not in self.bits:
            places = np.zeros(self.size, bool)
            places[self.slot[slice(*self.bounds[term])]] = True
            self.bits[term] = np.packbits(places)
        return self.bits[term]

    def score(self, query: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that hold one of the query's terms."""
        scores, bits = self.scores, np.zeros(-(-self.size // 8), np.uint8)
        for term, repeats in query:
            if term in self.bounds:
                a, b = self.bounds[term]
                scores[self.slot[a:b]] += repeats * self.share[a:b]  # a document is at most once in a list
                bits |= self.touched(term)
        places = np.flatnonzero(np.unpackbits(bits, count=self.size))
        found = scores[places]
        scores[places] = 0
        return places, found


def best_documents(held: DataFrame, queries, weights, n_docs: int, n_all: int, top: int, window: int) -> DataFrame:
    """The ``top`` documents of each query of a block: heaps of tasks over ranges of doc_ids, merged."""
    kind = held.schema["doc_id"].dataType.simpleString()
    arrow_id = pa.int64() if kind == "bigint" else pa.int32()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = queries.value, weights.value
        heaps: list[list] = [[] for _ in wanted]
        waiting: list[pa.RecordBatch] = []

        def take(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held, held[0].schema) if held else None
            for at in range(0, rows.num_rows if held else 0, window):
                score_window(rows.slice(at, window))

        def score_window(rows: pa.Table) -> None:
            lengths, terms, tfs = (rows.column(c) for c in ("n", "terms", "tfs"))
            here = WindowScores(lengths.to_numpy(), terms.to_pylist(), tfs.to_pylist(), weight, n_docs, n_all)
            ids = rows.column("doc_id").to_pylist()
            for heap, query in zip(heaps, wanted, strict=True):
                places, found = here.score(query)
                least = heap[0][0] if len(heap) == top else 1
                good = np.flatnonzero(found >= least)
                if len(good) > top:  # all that equal the last of the best stay, for the heap to choose by doc_id
                    good = good[found[good] >= np.partition(found[good], -top)[-top]]
                for place, score in zip(places[good].tolist(), found[good].tolist(), strict=True):
                    entry = (score, 0 if ids[place] is None else 1, -(ids[place] or 0))
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= window or sum(b.nbytes for b in waiting) >= WINDOW_BYTES:
                take(waiting)
                waiting = []
        take(waiting)
        rows = [(q, score, -key if there else None) for q, heap in enumerate(heaps) for score, there, key in heap]
        query, score, ids = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(ids, arrow_id), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])

    ranges = held.repartitionByRange(F.col("doc_id"), F.xxhash64("n", "terms", "tfs")).sortWithinPartitions("doc_id")  # many rows of one id share no task
    found = ranges.mapInArrow(search, f"query int, doc_id {kind}, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def ranked_documents(docs: DataFrame, items: DataFrame, top: int = 20, window: int = WINDOW, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``top`` documents with a score above 0."""
    spark = docs.sparkSession
    asked = materialize(query_terms(items), "query-terms")
    blocks = max(1, -(-asked.count() // block_terms))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    kind = items.schema["item_id"].dataType.simpleString()
    out = []
    for block in range(blocks):
        rows = asked.filter(F.col("block") == block).collect()  # about block_terms rows, or those of one item
        number = {term: i for i, term in enumerate(sorted({r["term"] for r in rows}))}
        by_item: dict = {}
        for r in rows:
            by_item.setdefault(r["item_id"], []).append((number[r["term"]], r["n"]))
        if not by_item:
            continue
        vocabulary = spark.sparkContext.broadcast({term.encode("utf-8", "surrogatepass"): i for term, i in number.items()})
        held = materialize(postings(docs, vocabulary), "postings")
        n_docs, n_all = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            discard(held)
            continue
        df = document_counts(held, len(number)).tolist()
        weights = spark.sparkContext.broadcast(np.array([floor(1000 * log((2 * n_docs + 2) / (2 * d + 1))) for d in df], np.int64))
        queries = spark.sparkContext.broadcast(list(by_item.values()))
        best = materialize(best_documents(held, queries, weights, n_docs, n_all, top, window), "best")
        discard(held)
        names = F.broadcast(spark.createDataFrame(list(enumerate(by_item)), f"query int, item_id {kind}"))  # the items of this block
        out.append(best.join(names, "query").select("item_id", "rank", "doc_id", "score"))
    discard(asked)
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score bigint")
    return reduce(DataFrame.unionByName, out)
