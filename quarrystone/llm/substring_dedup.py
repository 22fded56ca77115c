"""Repeated substrings by compaction of a token de Bruijn graph.

Every window of ``window`` consecutive words is an edge of the graph, from the node of its first to the node of its last
``window - 1`` words.  Only edges that occur in more than one document matter, and they are found in two steps, so that the bulk of
the windows is never shuffled:

* each window has a minimizer, the least hash of its ``seed``-word runs; equal windows have equal minimizers.  A grouped minimum
  and maximum tells which minimizers occur in different texts (copies of one text count as one text);
* windows with such a minimizer become edges (a 96-bit hash with the coordinate doc_id, place, and the words before and behind).
  One grouped pass gives, for each edge, its source (a place in the smallest doc_id), its occurrences, and the degrees that
  matter: whether one and the same word always follows (out-degree one behind the edge) and always precedes it.

An edge whose end leads on to one edge only, which in turn is reached from it only and occurs as often, does not branch there.
Such edges follow each other at their source too, so edges are compacted within blocks of source places, and the blocks' runs are
compacted to paths by rounds of joins that double the reach of each.  The beginning and the end of a text count as branches, so
whoever holds the first edge of a path holds all of it: only occurrences of first edges are joined with the paths, however long
these are.  Paths of very many occurrences are few, and are joined by
broadcast instead of in one task.

The source coordinate then verifies each span: a path's words are digested at its source, and a document loses the words of a span
only if they have the same digest.  Spans of one document may overlap; what they cover is removed.

The sets of repeated minimizers and of first edges go to the tasks as bitmaps, whose size is checked; beyond ``BITMAP_BITS`` the
minimizers are joined and the first edges are not filtered beforehand.

Defined results: a null text is an empty text; texts shorter than a window lose nothing; of equal texts (by words) all but the
one with the smallest doc_id lose every word, if a window fits; rows that share a doc_id are never compared with each other, and
each loses what it repeats of smaller doc_ids; there is one row for each input row; rows without doc_id are compared with
nothing and lose nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.near_dedup import MIX_A, MIX_B, word_hashes
from quarrystone.llm.shared import discard, id_and_text, join_counted, materialize

WINDOW = 13
SEED = 5
#: Largest bitmap of minimizers that is broadcast (32 MB), and bits for each minimizer.
BITMAP_BITS = 1 << 28
BITS_EACH = 24
CHUNK_BITS = 1 << 15
#: Up to so many document ids are broadcast to pick texts.
BROADCAST_ROWS = 500_000
#: Source places (a power of two of them) whose edges are compacted in one task; joins go on from there.
BLOCK_BITS = 10
#: Places of texts that share a doc_id are told apart by 32 bits of the text's hash above the position.
PLACE_BITS = 31



def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def run_hashes(w: np.ndarray, size: int, mix: np.uint64 = MIX_A) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(w) - size + 1
    h, spare, shift = np.full(n, size, np.uint64), np.empty(n, np.uint64), np.uint64(31)
    for k in range(size):
        h ^= w[k : k + n]
        h *= mix
        np.right_shift(h, shift, out=spare)
        h ^= spare
    return h


def minimizers(w: np.ndarray, window: int, seed: int) -> np.ndarray:
    """The minimizer of each window."""
    h = run_hashes(w, seed)
    n = len(w) - window + 1
    least = h[:n].copy()
    for k in range(1, window - seed + 1):
        np.minimum(least, h[k : k + n], out=least)
    return least


def text_slot(joined: bytes) -> int:
    """What tells texts with the same doc_id apart, as the upper bits of their places."""
    return (xxhash.xxh3_64_intdigest(joined) & 0xFFFFFFFF) << PLACE_BITS


def text_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, slot, digest); the digest is of all words joined by one space, so it also tells equal texts."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(text) for text in batch.column(1).to_pylist()]
            joined = [b" ".join(x) for x in words]
            columns = [pa.array(map(len, words), pa.int64()), pa.array(map(text_slot, joined), pa.int64()), pa.array([sha256(x).digest() for x in joined], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "slot", "digest"])

    return docs.mapInArrow(digest, "doc_id bigint, n_words bigint, slot bigint, digest binary")


def repeated_minimizers(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """Minimizers that occur in at least two different texts."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, found = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                if len(words) >= window:
                    marks.append(xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63))
                    found.append(np.unique(minimizers(word_hashes(words), window, seed)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["mark", "seeds"])

    rows = docs.filter("doc_id IS NOT NULL").mapInArrow(seeds, "mark bigint, seeds array<bigint>")
    rows = rows.select("mark", F.explode("seeds").alias("minimizer"))
    return rows.groupBy("minimizer").agg(F.min("mark").alias("a"), F.max("mark").alias("b")).filter("a < b").select("minimizer")


def bit_places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a bitmap of a power of two bits."""
    mask = np.uint64(bits - 1)
    return (values * MIX_B >> np.uint64(20) & mask).astype(np.int64), ((values ^ values >> np.uint64(33)) * MIX_A >> np.uint64(17) & mask).astype(np.int64)


def bitmap_of(minimizers_: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of a set, made in chunks by Spark; its size is fixed by ``bits``."""
    per_chunk = min(bits, CHUNK_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.unique(np.concatenate(bit_places(batch.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(both // per_chunk), pa.array(both % per_chunk)], names=["chunk", "place"])

    def fill(group: pa.Table) -> pa.Table:
        bitmap = np.zeros(per_chunk, np.uint8)
        bitmap[group.column("place").to_numpy()] = 1
        return pa.table({"chunk": group.column("chunk")[:1], "data": pa.array([np.packbits(bitmap).tobytes()], pa.binary())})

    chunks = minimizers_.mapInArrow(places, "chunk bigint, place bigint").distinct().groupBy("chunk").applyInArrow(fill, "chunk bigint, data binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in chunks.collect():  # at most bits / CHUNK_BITS rows of 4 KB
        out[row["chunk"] * per_chunk // 8 :][: per_chunk // 8] = np.frombuffer(row["data"], np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    ok = np.ones(len(values), bool)
    for place in bit_places(values, len(bitmap) * 8):
        ok &= (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def candidate_edges(docs: DataFrame, repeated: DataFrame, window: int, seed: int) -> DataFrame:
    """(edge, check, doc_id, place, before, behind) of the windows whose minimizer is (or, rarely, seems) repeated.

    ``docs`` has a flag ``shared`` for texts that share their doc_id with others.  ``before`` and ``behind`` are hashes of the words around the
    window (63 bits, the last one set), 0 where the text begins or ends.
    """
    n = repeated.count()
    bits = 1 << max(13, (n * BITS_EACH - 1).bit_length())
    shared = None
    if bits <= BITMAP_BITS:
        shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(repeated, bits))
        rows = docs.withColumn("hits", F.lit(None).cast("array<bigint>"))
    else:
        rows = docs.join(document_hits(docs, repeated, window, seed), "doc_id")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int32, np.int64, np.int64, np.int64, np.int64)
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in kinds]
            for doc_id, text, many, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if len(words) < window:
                    continue
                w = word_hashes(words)
                least = minimizers(w, window, seed)
                ok = in_bitmap(shared.value, least) if shared is not None else np.isin(least, np.array(hits, np.int64).view(np.uint64))
                pos = np.nonzero(ok)[0]
                if len(pos):
                    around = np.zeros(len(w) + 2, np.uint64)
                    around[1:-1] = w | np.uint64(1)
                    slot = text_slot(b" ".join(words)) if many else 0
                    edge, check = run_hashes(w, window)[pos], run_hashes(w, window, MIX_B)[pos] >> np.uint64(32)
                    values = (edge.view(np.int64), check.astype(np.uint32).view(np.int32), np.full(len(pos), doc_id, np.int64), pos + slot, around[pos].view(np.int64), around[pos + window + 1].view(np.int64))
                    for part, value in zip(parts, values, strict=True):
                        part.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, k), *p]).astype(k)) for p, k in zip(parts, kinds, strict=True)], names=["edge", "check", "doc_id", "place", "before", "behind"])

    return rows.select("doc_id", "text", "shared", "hits").mapInArrow(edges, "edge bigint, check int, doc_id bigint, place bigint, before bigint, behind bigint")


def document_hits(docs: DataFrame, repeated: DataFrame, window: int, seed: int) -> DataFrame:
    """The repeated minimizers of each document, by a join: the way for sets that are too large for a bitmap."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(text) for text in batch.column(1).to_pylist()]
            found = [np.unique(minimizers(word_hashes(x), window, seed)).view(np.int64) if len(x) >= window else None for x in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "seeds"])

    rows = docs.select("doc_id", "text").mapInArrow(seeds, "doc_id bigint, seeds array<bigint>").select("doc_id", F.explode("seeds").alias("minimizer"))
    return rows.join(repeated, "minimizer").groupBy("doc_id").agg(F.collect_set("minimizer").alias("hits"))  # no more than its windows


def repeated_edges(edges: DataFrame) -> DataFrame:
    """(edge, check, source_doc, source_place, n, leads_on, led_to) of the edges that occur in at least two doc_ids.

    ``leads_on``: all occurrences go on by one and the same word; ``led_to``: all come from one and the same.
    """
    found = edges.groupBy("edge", "check").agg(
        F.min("doc_id").alias("source_doc"),
        F.min_by("place", "doc_id").alias("source_place"),
        F.max("doc_id").alias("last"),
        F.count("*").alias("n"),
        *[f(c).alias(f"{name}_{c}") for c in ("before", "behind") for name, f in (("all", F.bit_and), ("any", F.bit_or))],
    )
    same = lambda c: (F.col(f"all_{c}") == F.col(f"any_{c}")) & (F.col(f"all_{c}") != 0)
    return found.filter("source_doc < last").select("edge", "check", "source_doc", "source_place", "n", same("behind").alias("leads_on"), same("before").alias("led_to"))


def compacted(edges: DataFrame) -> DataFrame:
    """(edge, check, source_doc, start, end, n): maximal nonbranching paths, named by their first edge, over source places."""
    block = F.shiftright("source_place", BLOCK_BITS)
    by_place = Window.partitionBy("source_doc", "block").orderBy("source_place")
    goes_on = F.col("led_to") & F.lag("leads_on").over(by_place) & (F.lag("source_place").over(by_place) == F.col("source_place") - 1) & (F.lag("n").over(by_place) == F.col("n"))
    runs = edges.withColumn("block", block).withColumn("begins", F.when(goes_on, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("begins").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "source_place").alias(c)
    runs = runs.groupBy("source_doc", "block", "run").agg(first("edge"), first("check"), first("led_to"), F.max_by("leads_on", "source_place").alias("leads_on"), F.min("source_place").alias("start"), (F.max("source_place") + 1).alias("end"), F.min("n").alias("n"))
    runs = materialize(runs.drop("block", "run"), "runs")

    # Runs that touch the borders of their blocks go on by joins; each round doubles how many runs a path reaches over.
    at_border = lambda c: F.col(c) % (1 << BLOCK_BITS) == 0
    crosses = (F.col("leads_on") & at_border("end")) | (F.col("led_to") & at_border("start"))
    reach = materialize(runs.filter(crosses).select("source_doc", "start", "end", "n", "leads_on", "led_to"), "reach")
    inner = None
    while True:
        ahead = reach.filter("led_to").select("source_doc", F.col("start").alias("end"), "n", F.col("end").alias("next_end"), F.col("leads_on").alias("next_leads_on"), F.col("start").alias("inner_start"))
        met = reach.filter("leads_on").join(ahead, ["source_doc", "end", "n"])
        if inner is None:
            inner = materialize(met.select("source_doc", F.col("inner_start").alias("start")), "inner-runs")
        grown = reach.join(ahead, ["source_doc", "end", "n"], "left")
        on = F.col("leads_on") & F.col("next_end").isNotNull()
        grown = materialize(grown.select("source_doc", "start", F.when(on, F.col("next_end")).otherwise(F.col("end")).alias("end"), "n", (on & F.col("next_leads_on")).alias("leads_on"), "led_to"), "reach")
        discard(reach)
        reach = grown
        if not reach.filter("leads_on").limit(1).count():
            break
    names = ["edge", "check", "source_doc", "start", "n"]
    whole = runs.filter(~crosses).select(*names, "end")
    joined = runs.filter(crosses).select(*names).join(inner, ["source_doc", "start"], "left_anti").join(reach.select("source_doc", "start", "end"), ["source_doc", "start"])
    return whole.unionByName(joined.select(*names, "end"))


def texts_of(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts with what ``lists`` (one row a doc_id) holds for them; ids are broadcast where they are few, and texts shuffled once."""
    ids = lists.select("doc_id")
    return docs.join(F.broadcast(ids) if lists.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi").join(lists, "doc_id")


def span_digest(words: list[bytes], start: int, end: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words[start:end]))


def own_places(words: list[bytes], places: list[int]) -> list[int | None]:
    """Positions of places in this text; none for those of another text with the same doc_id."""
    slot = None
    out: list[int | None] = []
    for place in places:
        if place >> PLACE_BITS and slot is None:
            slot = text_slot(b" ".join(words))
        out.append(place & ((1 << PLACE_BITS) - 1) if place >> PLACE_BITS == 0 or place >> PLACE_BITS == slot >> PLACE_BITS else None)
    return out


def with_source_digests(docs: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """The paths with the digest of their words at their source."""
    lists = materialize(paths.groupBy(F.col("source_doc").alias("doc_id")).agg(F.collect_list(F.struct("edge", "check", "start", "end", "n")).alias("paths")), "source-paths")  # no more than its windows
    schema = pa.schema([("edge", pa.int64()), ("check", pa.int32()), ("source_doc", pa.int64()), ("start", pa.int64()), ("n_windows", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                for path, at in zip(held, own_places(words, [p["start"] for p in held]), strict=True):
                    n_windows = path["end"] - path["start"]
                    if at is not None:
                        rows.append((path["edge"], path["check"], doc_id, path["start"], n_windows, path["n"], span_digest(words, at, at + n_windows + window - 1)))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types, strict=True)], schema=schema)

    told = texts_of(docs, lists).select("doc_id", "text", "paths").mapInArrow(digest, "edge bigint, check int, source_doc bigint, start bigint, n_windows bigint, n bigint, digest binary")
    return told.dropDuplicates(["edge", "check"])  # the source may be in the table more than once


def path_occurrences(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Occurrences of the paths' first edges with their path; no key of the shuffle has more than a bounded share of the rows."""
    n_paths = paths.count()
    bits = 1 << max(13, (n_paths * BITS_EACH - 1).bit_length())
    begins = edges.select("edge", "check", "doc_id", "place")
    if bits <= BITMAP_BITS:
        shared = edges.sparkSession.sparkContext.broadcast(bitmap_of(paths.select(F.col("edge").alias("minimizer")), bits))

        def first_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(shared.value, batch.column(0).to_numpy().view(np.uint64))))

        begins = begins.mapInArrow(first_edges, begins.schema)
    return join_counted(begins, paths, ["edge", "check"], "n")


def repeated_paths(docs: DataFrame, copies: DataFrame, shared_ids: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, start, n_windows, source_doc, source_start, digest): spans that also occur in a document with a smaller doc_id.

    Starts are places: positions, below 32 bits of the text's hash where its doc_id is one of ``shared_ids``.  ``copies`` (doc_id)
    are later copies of whole texts: the first copy has all their edges with a smaller doc_id, so theirs are left out.
    """
    docs = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    repeated = materialize(repeated_minimizers(docs, window, seed), "minimizers")
    own = docs.filter("doc_id IS NOT NULL").join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "doc_id", "left_anti")
    n_shared = shared_ids.count()
    if n_shared:
        told = shared_ids.withColumn("shared", F.lit(True))
        own = own.join(F.broadcast(told) if n_shared <= BROADCAST_ROWS else told, "doc_id", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    else:
        own = own.withColumn("shared", F.lit(False))
    edges = materialize(candidate_edges(own, repeated, window, seed), "edges")
    discard(repeated)
    paths = compacted(materialize(repeated_edges(edges), "repeated-edges"))
    paths = materialize(with_source_digests(docs, paths, window), "paths")
    seen = path_occurrences(edges, paths).filter("source_doc < doc_id")
    return seen.select("doc_id", F.col("place").alias("start"), "n_windows", "source_doc", F.col("start").alias("source_start"), "digest")


def remove_repeated(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text): what is left of every document, words joined by one space.

    ``kept_text`` is null where nothing is removed (the document's own text stands) and empty where everything is.
    """
    docs = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    digests = materialize(text_digests(docs), "digests")
    firsts = digests.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    marked = join_counted(digests, materialize(firsts, "first-copies"), ["digest"], "n", "left").withColumn("copy", F.coalesce((F.col("first") < F.col("doc_id")) & (F.col("n_words") >= window), F.lit(False)))
    by_id = marked.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and("copy").alias("all_copies"), (F.min("slot") < F.max("slot")).alias("shared"))
    by_id = materialize(by_id.filter("all_copies OR shared"), "copies")
    spans = repeated_paths(docs, by_id.filter("all_copies").select("doc_id"), by_id.filter("shared").select("doc_id"), window, seed)
    spans = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n_windows", "digest")).alias("spans"))  # no more than its windows
    # Under a shared doc_id some texts can be whole copies; they are settled, and not cut.
    settled = marked.filter("copy").join(F.broadcast(by_id.filter("NOT all_copies").select("doc_id")) if by_id.count() <= BROADCAST_ROWS else by_id.filter("NOT all_copies").select("doc_id"), "doc_id", "left_semi")
    settled = settled.groupBy("doc_id").agg(F.collect_set("slot").alias("settled"))
    spans = materialize(spans.join(settled, "doc_id", "left"), "spans")
    names = ["doc_id", "n_words", "n_removed", "digest", "kept_text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests, kept = [], [], [], []
            ids = []
            for doc_id, text, spans, settled in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if settled and text_slot(b" ".join(words)) in settled:
                    continue
                ids.append(doc_id)
                gone = np.zeros(len(words), bool)
                for span, at in zip(spans, own_places(words, [s["start"] for s in spans]), strict=True):
                    if at is not None and span_digest(words, at, at + span["n_windows"] + window - 1) == span["digest"]:
                        gone[at : at + span["n_windows"] + window - 1] = True
                left = b" ".join([word for word, x in zip(words, gone.tolist(), strict=True) if not x])
                counts.append(len(words)), removed.append(int(gone.sum())), digests.append(sha256(left).digest())
                kept.append(left.decode("utf-8", "surrogatepass") if removed[-1] else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.string())], names=names)

    changed = texts_of(docs, spans).select("doc_id", "text", "spans", "settled").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, digest binary, kept_text string")
    ids = spans.select("doc_id", F.lit(True).alias("has_spans"))
    others = marked.join(F.broadcast(ids) if spans.count() <= BROADCAST_ROWS else ids, "doc_id", "left").filter("copy OR has_spans IS NULL")
    nothing = F.lit(bytearray(sha256(b"").digest()))
    others = others.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.col("digest")).alias("digest"),
        F.when(F.col("copy"), F.lit("")).alias("kept_text"),
    )
    out = others.unionByName(changed)
    return out.select("doc_id", "n_words", "n_removed", F.lower(F.hex("digest")).alias("kept_sha256"), "kept_text")
