"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every text becomes a sparse vector: its distinct words hashed to ``WORD_SLOTS`` slots with equal weights of unit length in all,
and one active slot for each statistic (share of capitals, of repeated neighbours, of symbols, length as the table states it,
and so on), chosen by the quantiles of the training rows.  The machine scores it as

    bias + sum w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2 ]

whose last part is all pairwise interactions <v_i, v_j> x_i x_j in time linear in the active slots (the sum-of-squares
identity).  It is fitted by AdaGrad on a bounded sample of labelled rows: the ``max_rows`` with the least hash of doc_id.  The
model is a fixed few hundred KB and is broadcast; scoring reads each text once and shuffles nothing.

Labels, language, source and doc_id are never part of a vector.

Defined results: a null text is scored as an empty text; an empty text has no words and its statistics are 0; a null length
counts as the text's own; without usable labels of both kinds every score is the smoothed share of label 1, or 0.5 without any;
repeated rows are scored once each; of several texts with one doc_id the least is fitted; rows that are labelled more than once count with their lowest label; a null doc_id is never
held out; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from math import log1p
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.shared import forget_words

WORD_SLOTS = 1 << 14
FACTORS = 8
BINS = 8
#: Most labelled rows that a model is fitted on.
MAX_ROWS = 4096
EPOCHS = 8
THRESHOLD = 0.7

STATISTICS = (
    "log_chars", "log_words", "mean_word", "distinct_words", "top_word", "repeated_neighbours", "capital_words", "capitals",
    "digits", "symbols", "symbol_ends", "spaces", "lines", "distinct_lines", "mean_line", "stated_chars",
)


def word_slots(words: Iterable[str]) -> np.ndarray:
    return np.unique(np.array([crc32(word.encode("utf-8", "surrogatepass")) % WORD_SLOTS for word in words], np.int64))


_UPPER, _DIGIT, _SPACE = (np.frombuffer(x, np.uint8) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c"))
_SYMBOL = np.frombuffer(b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~", np.uint8)


def describe(text: str, stated: int | None) -> tuple[np.ndarray, list[float]]:
    """Distinct word slots and the statistics, in the order of ``STATISTICS``."""
    words = text.split()
    counts = Counter(words)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n, chars = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    statistics = [
        log1p(len(text)),
        log1p(len(words)),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        sum(map(str.isupper, words)) / n,
        float(raw[_UPPER].sum()) / chars,
        float(raw[_DIGIT].sum()) / chars,
        float(raw[_SYMBOL].sum()) / chars,
        sum(not word[-1].isalnum() and word[-1] not in ".," for word in words) / n,
        float(raw[_SPACE].sum()) / chars,
        log1p(len(lines)),
        len(set(lines)) / len(lines),
        log1p(len(text) / len(lines)),
        log1p(len(text) if stated is None else max(0, stated)),
    ]
    return word_slots(counts), statistics


@dataclass
class Model:
    """Bin borders of the statistics, and the machine's weights; ``prior`` alone where nothing could be learned."""

    borders: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    prior: float | None = None

    def vector(self, slots: np.ndarray, statistics: list[float]) -> tuple[np.ndarray, np.ndarray]:
        bins = (np.array(statistics)[:, None] > self.borders).sum(axis=1)
        where = np.concatenate((slots, WORD_SLOTS + np.arange(len(STATISTICS)) * BINS + bins))
        values = np.ones(len(where), np.float32)
        values[: len(slots)] = 1 / np.sqrt(max(1, len(slots)))
        return where, values

    def margin(self, where: np.ndarray, values: np.ndarray) -> float:
        terms = self.factors[where] * values[:, None]
        total = terms.sum(axis=0)
        return float(self.bias + self.weights[where] @ values + 0.5 * (total @ total - (terms * terms).sum()))

    def score(self, text: str | None, stated: int | None) -> float:
        if self.prior is not None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.margin(*self.vector(*describe(text or "", stated))), -30, 30))))


def fit_rows(rows: list[tuple[np.ndarray, list[float], int]], epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """AdaGrad over described rows (slots, statistics, label) of the bounded sample."""
    labels = np.array([row[2] for row in rows], np.float64)
    size = WORD_SLOTS + len(STATISTICS) * BINS
    if len(set(labels)) < 2:
        prior = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros((len(STATISTICS), BINS - 1)), 0.0, np.zeros(0), np.zeros((0, 0)), float(prior))
    values = np.array([row[1] for row in rows])
    borders = np.quantile(values, np.arange(1, BINS) / BINS, axis=0).T
    # Extremes matter most here: the outer borders go to the last percents.
    borders[:, 0], borders[:, -1] = np.quantile(values, 0.03, axis=0), np.quantile(values, 0.97, axis=0)
    rng = np.random.default_rng(7)
    model = Model(borders, float(np.log(labels.mean() / (1 - labels.mean()))), np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32))
    vectors = [model.vector(row[0], row[1]) for row in rows]
    seen_w, seen_v, seen_b = np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        for k in rng.permutation(len(rows)).tolist():
            where, x = vectors[k]
            v = model.factors[where]
            terms = v * x[:, None]
            total = terms.sum(axis=0)
            margin = model.bias + model.weights[where] @ x + 0.5 * (total @ total - (terms * terms).sum())
            slope = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[k]
            grad_w = slope * x + decay * model.weights[where]
            grad_v = slope * (x[:, None] * total - v * (x * x)[:, None]) + decay * v
            seen_b += slope * slope
            seen_w[where] += grad_w * grad_w
            seen_v[where] += grad_v * grad_v
            model.bias -= rate * slope / np.sqrt(seen_b)
            model.weights[where] -= rate * grad_w / np.sqrt(seen_w[where])
            model.factors[where] -= 0.5 * rate * grad_v / np.sqrt(seen_v[where])
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _inputs(docs: DataFrame) -> list[Column]:
    stated = docs["n_chars"] if "n_chars" in docs.columns else F.lit(None)
    return [docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), stated.cast("bigint").alias("stated")]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled documents that are not held out."""
    usable = labels.select(labels["doc_id"].alias("doc_id"), labels[label_col].alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    usable = usable.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, stated, label = (c.to_pylist() for c in batch.columns)
            both = [describe(text or "", n) for text, n in zip(texts, stated, strict=True)]
            columns = [pa.array(ids, pa.int64()), pa.array([x[0] for x in both], pa.list_(pa.int64())), pa.array([x[1] for x in both], pa.list_(pa.float64())), pa.array(label, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "slots", "statistics", "label"])

    rows = docs.select(*_inputs(docs)).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "stated", "label")).alias("least")).select("doc_id", "least.*")
    rows = rows.select(F.col("doc_id").cast("bigint"), "text", "stated", F.col("label").cast("int")).mapInArrow(features, "doc_id bigint, slots array<bigint>, statistics array<double>, label int")
    found = sorted(rows.collect(), key=lambda r: r["doc_id"])  # at most max_rows rows
    return fit_rows([(np.array(r["slots"], np.int64), r["statistics"], r["label"]) for r in found])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        model = shared.value
        for batch in batches:
            scores = [model.score(text, n) for text, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select(*_inputs(docs)).mapInArrow(judge, f"doc_id {ids}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are predicted good; columns as they came.  Rows are scored in place, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    stated = "n_chars" in docs.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        model = shared.value
        for batch in batches:
            lengths = batch.column("n_chars").to_pylist() if stated else [None] * batch.num_rows
            good = [model.score(text, n) >= threshold for text, n in zip(batch.column("text").to_pylist(), lengths, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)
