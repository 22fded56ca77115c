"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its pairs of neighbouring lower-cased words, hashed to 64-bit terms (of 32-bit word hashes) and weighted by their
counts.  For each term and sample there are two gamma(2, 1) variates and a uniform one, hashed from both and so the same for every document; the
sample of a document is the term, with its quantised log weight, that minimises Ioffe's exponential race.  Two documents
agree on a sample with a probability that equals their generalised Jaccard similarity (sum of minima over sum of maxima),
so the share of agreeing samples estimates it.  Each sample is kept as 16 bits, and the fingerprint is their hex text.

Defined results: a null text is an empty text; an empty text has the fingerprint of the empty set, which agrees fully with
itself and with nothing else; a text of one word has that word as its only term; equal texts have equal fingerprints;
rows with equal ids are ordered by text; rows without an id have no place in the order, so an empty text follows each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.shared import forget_words, id_and_text

SAMPLES = 64


#: Terms that race at once, and buffers for them: one set a worker process and number of samples.
BLOCK = 512
_BUFFERS: dict[int, tuple[np.ndarray, ...]] = {}
#: The log of 2^64, which scales products of two 32-bit numbers to uniforms, and the least gamma variate.
LOG_SCALE, LEAST = np.float32(64 * np.log(2)), np.float32(2.0**-24)


def _stir(x: np.ndarray, spare: np.ndarray) -> None:
    """Mixes products of 64-bit numbers in place."""
    np.right_shift(x, np.uint64(32), out=spare)
    x ^= spare
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    np.right_shift(x, np.uint64(32), out=spare)
    x ^= spare


def _buffers(samples: int) -> tuple[np.ndarray, ...]:
    if samples not in _BUFFERS:
        keys = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _stir(keys, np.empty_like(keys))
        keys |= np.uint64(1)
        hashes = [np.empty((BLOCK, samples), np.uint64) for _ in range(3)]
        halves = [np.empty((BLOCK, 2 * samples), np.float32) for _ in range(2)]
        _BUFFERS[samples] = keys, *hashes, *halves, *[np.empty((BLOCK, samples), np.float32) for _ in range(2)]
    return _BUFFERS[samples]


def variates(terms: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, ...]:
    """r, ln c and beta for each sample of at most BLOCK 64-bit terms, hashed from both: the same on every machine.

    A gamma(2, 1) variate is minus the log of a product of two uniforms; the halves of two hashes, the second a mix of the first, give the
    four, and the second goes on to beta.  The arrays are overwritten by the next call.
    """
    n = len(terms)
    keys, *rest = _buffers(samples)
    first, second, spare, gamma, other, log_c, beta = (buffer[:n] for buffer in rest)
    base = (terms.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    _stir(base, np.empty_like(base))
    np.multiply(base[:, None], keys, out=first)
    _stir(first, second)
    np.multiply(first, np.uint64(0xBF58476D1CE4E5B9), out=second)
    np.right_shift(second, np.uint64(32), out=spare)
    second ^= spare
    np.copyto(gamma, first.view(np.uint32))
    np.copyto(other, second.view(np.uint32))
    gamma *= other
    np.maximum(gamma, np.float32(1), out=gamma)  # a half can be zero
    np.log(gamma, out=gamma)
    np.subtract(LOG_SCALE, gamma, out=gamma)
    np.maximum(gamma, LEAST, out=gamma)
    np.copyto(log_c, gamma[:, 1::2])  # next to each other the logs are faster
    np.log(log_c, out=log_c)
    second *= np.uint64(0x94D049BB133111EB)
    second >>= np.uint64(40)
    np.copyto(beta, second.view(np.int64), casting="unsafe")  # converts much faster
    beta *= LEAST
    return gamma[:, 0::2], log_c, beta


def weighted_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit terms and their counts."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.float32)
    digest = {word: crc32(word) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF for word in set(words)}
    h = np.fromiter(map(digest.__getitem__, words), np.uint64, len(words))
    if len(h) > 1:
        h = h[:-1] * np.uint64(0xBF58476D1CE4E5B9) ^ (h[1:] >> np.uint64(7))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    terms, counts = np.unique(h, return_counts=True)
    return terms, counts.astype(np.float32)


def races(terms: np.ndarray, weights: np.ndarray, ends: list[int], samples: int = SAMPLES) -> list[tuple[np.ndarray, ...]]:
    """For each part of the terms, which ends where ``ends`` says, and each sample the least value, its term and its quantised weight.

    All parts go through the same blocks, which bound the memory.  An empty part has infinite values.
    """
    out = [(np.full(samples, np.inf, np.float32), np.zeros(samples, np.uint64), np.zeros(samples, np.int64)) for _ in ends]
    column = np.arange(samples)
    for at in range(0, len(terms), BLOCK):
        keys, counts = terms[at : at + BLOCK], weights[at : at + BLOCK]
        r, values, beta = variates(keys, samples)
        heavy = np.flatnonzero(counts != 1)  # of a weight of 1 the log is 0, and so is the step
        steps = np.zeros((1 + len(heavy), samples), np.float32)
        steps[1:] = np.floor(np.log(counts[heavy])[:, None] / r[heavy] + beta[heavy])
        beta[heavy] -= steps[1:]
        beta -= 1
        beta *= r
        values += beta
        place = np.zeros(len(keys), np.int64)
        place[heavy] = np.arange(1, len(heavy) + 1)
        for begin, end, (best, term, step) in zip([0, *ends], ends, out, strict=False):
            low, high = max(begin - at, 0), min(end - at, len(keys))
            if low < high:
                row = values[low:high].argmin(axis=0) + low
                value = values[row, column]
                won = value < best
                best[won], term[won], step[won] = value[won], keys[row[won]], steps[place[row[won]], column[won]].astype(np.int64)
    return out


def sealed(*races: tuple[np.ndarray, ...]) -> np.ndarray:
    """One 16-bit value a sample, for the term and quantised weight that win over all races; zeros where none was run."""
    best, term, step = races[0]
    for value, other, steps in races[1:]:
        won = value < best
        best, term, step = np.where(won, value, best), np.where(won, other, term), np.where(won, steps, step)
    with np.errstate(over="ignore"):
        mixed = (term * np.uint64(0x9E3779B97F4A7C15)) ^ (step.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)
    return np.where(np.isinf(best), 0, mixed % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def signature(terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    return sealed(*races(terms, weights, [len(terms)], samples))


def signatures(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Both signatures; what has the same weight in both races once."""
    (a, wa), (b, wb) = one, two
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    equal = wa[i] == wb[j]
    own, other = np.ones(len(a), bool), np.ones(len(b), bool)
    own[i[equal]], other[j[equal]] = False, False
    parts = [(a[~own], wa[~own]), (a[own], wa[own]), (b[other], wb[other])]
    shared, first, second = races(*map(np.concatenate, zip(*parts, strict=True)), np.cumsum([len(t) for t, _ in parts]).tolist(), samples)
    return sealed(shared, first), sealed(shared, second)


def text_signature(text: str, samples: int = SAMPLES) -> np.ndarray:
    return signature(*weighted_terms(text), samples)


def hex_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of samples on which two signatures agree."""
    return float((a == b).mean())


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every whole text; nothing is shuffled."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            prints = [hex_text(text_signature(text, samples)) for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(prints, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return id_and_text(docs).mapInArrow(sketch, f"doc_id {ids}, n_chars bigint, fingerprint string")


def in_blocks(docs: DataFrame, n_blocks: int) -> DataFrame:
    """Every document with its block of neighbouring ids, plus the first document of each block as the last of the one before.

    Block borders are approximate quantiles of the ids, so a block has a bounded share of the rows; the first document of all
    closes the last block.  ``ghost`` marks the added rows.
    """
    base = id_and_text(docs)
    borders = base.approxQuantile("doc_id", [i / n_blocks for i in range(1, n_blocks)], 0.25 / n_blocks) if n_blocks > 1 else []
    borders = sorted(set(borders))
    shared = docs.sparkSession.sparkContext.broadcast(np.array(borders, np.float64))  # a number for each block

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, ids.to_numpy(), side="right"), dtype="int32")

    # Rows without an id need no neighbour and are dealt by their text.
    base = base.withColumn("block", F.when(F.col("doc_id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(n_blocks)).cast("int")).otherwise(block_of(F.coalesce("doc_id", F.lit(0)))))
    firsts = sorted((r["block"], r["first"]) for r in base.filter("doc_id IS NOT NULL").groupBy("block").agg(F.min("doc_id").alias("first")).collect())  # a row for each block
    before = {first: block for (block, _), (_, first) in zip(firsts, firsts[1:] + firsts[:1], strict=True)}
    if not before:
        return base.withColumn("ghost", F.lit(False))
    goes = F.broadcast(docs.sparkSession.createDataFrame(list(before.items()), "first bigint, goes int"))
    # Rows that share the first id: only the one with the least text is the neighbour.
    ghosts = base.join(goes, F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("doc_id", "goes").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return base.withColumn("ghost", F.lit(False)).unionByName(ghosts.select("doc_id", "text", F.col("goes").alias("block"), F.lit(True).alias("ghost")))


#: Blocks for each partition, so that hashing them deals out even shares.
BLOCKS_EACH = 8


def edited_neighbours(docs: DataFrame, partitions: int, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, compared.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all) of the next document's.
    One shuffle brings neighbours together; tasks stream over sorted rows and hold two documents.
    """
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        empty = signature(*weighted_terms(""), samples)
        held = waiting = None  # a document without its next one, and the row before it that lacks only near_next
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, block, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                terms = weighted_terms(text)
                if doc_id is None:  # sorted before all others of its partition
                    rows.append(done(one((None, text, terms, block), ""), empty))
                    continue
                if held is not None and held[3] == block:
                    row, sig = one(held, text)
                    if waiting is not None:
                        rows.append(done(waiting, sig))
                    waiting = row, sig
                elif waiting is not None:
                    rows.append(done(waiting, signature(*held[2], samples)))
                    waiting = None
                if ghost and waiting is not None:
                    rows.append(done(waiting, signature(*terms, samples)))
                    waiting = None
                held = None if ghost else (doc_id, text, terms, block)
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows], schema=kinds)
        if waiting is not None:
            last = done(waiting, signature(*held[2], samples))
            yield pa.RecordBatch.from_pylist([dict(zip(names, last, strict=True))], schema=kinds)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)))

    def one(held: tuple, next_text: str) -> tuple[tuple, np.ndarray]:
        doc_id, text, terms, _ = held
        cut = len(text) // 4
        edited = text[: len(text) - cut] + next_text[:cut]
        sig, other = signatures(terms, weighted_terms(edited), samples)
        digest = sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, len(text), digest, hex_text(sig), hex_text(other), likeness(sig, other)), sig

    def done(waiting: tuple[tuple, np.ndarray], next_sig: np.ndarray) -> tuple:
        row, sig = waiting
        return *row, likeness(sig, next_sig)

    dealt = in_blocks(docs, partitions * BLOCKS_EACH).select("doc_id", "text", "block", "ghost")
    dealt = dealt.repartition(partitions, "block").sortWithinPartitions("block", "ghost", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    return dealt.mapInArrow(compare, schema)
