"""Models behind small protocols, applied to DataFrames in Arrow batches, with deterministic stand-ins for offline use."""

from __future__ import annotations

import json
import math
import queue
import re
import threading
from collections.abc import Callable, Iterator
from typing import Protocol
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.config import Settings
from quarrystone.session import prepare


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class Reranker(Protocol):
    def __call__(self, query: str, texts: list[str]) -> list[float]: ...


class HashEmbedder:
    """Unit vectors of hashed words: equal texts get equal vectors, texts that share words near ones."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimensions)
            for word in re.findall(r"\w+", text.lower()):
                h = crc32(word.encode())
                v[h % self.dimensions] += 1 if h >> 16 & 1 else -1
            norm = math.sqrt(float(v @ v))
            out.append((v / norm if norm else v).tolist())
        return out


class OverlapReranker:
    """The share of the query's words that a text holds, as a logit."""

    def __call__(self, query: str, texts: list[str]) -> list[float]:
        asked = set(re.findall(r"\w+", query.lower()))
        return [6 * len(asked & set(re.findall(r"\w+", text.lower()))) / max(1, len(asked)) - 3 for text in texts]


class EchoGenerator:
    """A list of the prompt's longest words, as JSON."""

    def __call__(self, prompts: list[str]) -> list[str]:
        return [json.dumps(sorted(set(re.findall(r"\w{6,}", p.lower())), key=lambda w: (-len(w), w))[:4], ensure_ascii=False) for p in prompts]


def vectors_of(embedder: Embedder, texts: list[str]) -> list[list[float]]:
    """A batch's vectors; if the batch fails or comes back short, one text after the other.  A text that has none fails the job."""
    try:
        vectors = embedder(texts)
        if len(vectors) == len(texts):
            return vectors
    except Exception as error:
        if len(texts) == 1:
            raise ValueError("a text could not be embedded, so nothing is stored") from error
    if len(texts) == 1:
        raise ValueError(f"{len(vectors)} vectors for one text, so nothing is stored")
    return [vectors_of(embedder, [text])[0] for text in texts]


def embed(texts: DataFrame, embedder: Embedder, key: str = "key", text: str = "text") -> DataFrame:
    """(key, embedding) of every text; what can't be embedded fails the job, so nothing partial is stored."""
    prepare(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = vectors_of(embedder, [t or "" for t in batch.column(1).to_pylist()]) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=[key, "embedding"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def embed_with_cache(texts: DataFrame, cache: DataFrame, embedder: Embedder, model: str) -> DataFrame:
    """(key, embedding) of the distinct texts, keyed by model and text; only texts that the cache lacks are embedded."""
    wanted = texts.select("text").distinct().select(F.sha2(F.concat_ws(":", F.lit(model), "text"), 256).alias("key"), "text")
    missing = wanted.join(cache.select("key"), "key", "left_anti")
    return cache.join(wanted.select("key"), "key", "left_semi").select("key", "embedding").unionByName(embed(missing, embedder))


def cache_statistics(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: requests (key, one row each), hits in the cache as it was, misses, the hit rate and the entries stored."""
    told = requests.join(cache.select("key", F.lit(1).alias("hit")), "key", "left")
    counts = told.agg(F.count("*").alias("requests"), F.count("hit").alias("hits")).join(cache.agg(F.count("*").alias("entries")))
    return counts.select("requests", "hits", (F.col("requests") - F.col("hits")).alias("misses"), F.round(F.col("hits") / F.greatest("requests", F.lit(1)), 4).alias("hit_rate"), "entries")


def rerank(found: DataFrame, queries: DataFrame, reranker: Reranker, settings: Settings | None = None, cap: int = 4000, seconds: float | None = None) -> DataFrame:
    """Reorder the first ``rerank_top_n`` documents of each query by a model; the rest follow in their old order.

    A query's documents are a bounded list.  If the model fails on a query, or takes longer than ``seconds`` for it, that query keeps its
    order and its scores, and ``degraded`` says why (null otherwise).
    """
    s = settings or Settings()
    prepare(found.sparkSession)

    def judged_by(model: Reranker, query: str, texts: list[str]) -> list[float]:
        scores = [1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) for x in model(query, [(t or "")[:cap] for t in texts])]
        if len(scores) != len(texts):
            raise ValueError(f"{len(scores)} scores for {len(texts)} texts")
        return scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, reasons = [], []
            for query, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    scores.append(within(seconds, judged_by, reranker, query, texts))
                    reasons.append(None)
                except Exception as error:  # a model's failure must not lose the documents
                    scores.append(None)
                    reasons.append("timeout" if isinstance(error, TimeoutError) else f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.list_(pa.float64())), pa.array(reasons, pa.string())], names=["query_id", "scores", "degraded"])

    head = found.filter(F.col("position") <= s.rerank_top_n).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("list"))
    head = head.join(queries.select("query_id", F.col("text").alias("query")), "query_id").select("query_id", "query", F.transform("list", lambda x: x["text"]).alias("texts"))
    kind = found.schema["query_id"].dataType.simpleString()
    judged = head.mapInArrow(run, f"query_id {kind}, scores array<double>, degraded string")
    both = found.join(judged, "query_id", "left").withColumn("new_score", F.get("scores", F.col("position") - 1))
    by = Window.partitionBy("query_id").orderBy(F.col("new_score").isNull(), F.desc("new_score"), "position")
    return both.withColumn("score", F.coalesce("new_score", "score")).withColumn("position", F.row_number().over(by)).drop("scores", "new_score")


def within(seconds: float | None, call: Callable, *args):
    """The call's result, or ``TimeoutError`` after so many seconds; the thread of a call that was given up ends by itself."""
    if seconds is None:
        return call(*args)
    told: queue.Queue = queue.Queue()

    def work() -> None:
        try:
            told.put((call(*args), None))
        except Exception as error:
            told.put((None, error))

    threading.Thread(target=work, daemon=True).start()
    try:
        result, error = told.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError from None
    if error:
        raise error
    return result


def string_list(text: str | None, limit: int = 500) -> list[str]:
    """The strings of a JSON array in a model's answer: as it stands, with missing opening marks put back, or any quoted parts."""
    raw = (text or "").strip()
    cut = re.search(r"\[.*\]", raw, re.S)
    for candidate in (raw, f"[{raw}", f'["{raw}', cut[0] if cut else ""):
        try:
            found = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(found, list):
            break
    else:
        found = re.findall(r'"([^"]+)"', raw)
    kept = [x.strip() for x in found if isinstance(x, str) and len(x.strip()) >= 3]
    return [x[:limit] for x in dict.fromkeys(kept)]


def expand(queries: DataFrame, generator: Generator, variants: int = 4) -> DataFrame:
    """(query_id, nth, text): each question and the variants that a generator gives, without repeats."""
    prepare(queries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lists = [list(dict.fromkeys([t, *string_list(a)[:variants]])) for t, a in zip(texts, generator(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], names=["query_id", "texts"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "text").mapInArrow(run, f"query_id {kind}, texts array<string>").select("query_id", F.posexplode("texts").alias("nth", "text"))


REWRITE, VARIANTS, PASSAGE = "Rewrite the question so that it stands alone.", "Give other wordings as a JSON array.", "Write a passage that answers the question."


def expand_with_history(queries: DataFrame, generator: Generator, dense: bool = True, variants: int = 4) -> DataFrame:
    """(query_id, nth, kind, text) from (query_id, text, history), without repeats: the question, its rewriting in the light of the
    history (none without one, or if it has at most three characters), up to ``variants`` wordings, and for dense search a passage that could
    answer it.  If a generator fails on a batch, its questions stand alone.
    """
    prepare(queries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ask(task: str, texts: list[str]) -> list[str]:
            try:
                return [strip_reasoning(x or "").strip() for x in generator([f"{task}\n{t}" for t in texts])]
            except Exception:  # widening is optional
                return [""] * len(texts)

        for batch in batches:
            texts, past = ([t or "" for t in batch.column(i).to_pylist()] for i in (1, 2))
            told = [bool(h.strip()) for h in past]
            new = iter(ask(REWRITE, [f"{h}\n{t}" for t, h, ok in zip(texts, past, told, strict=True) if ok]))
            rewritten = [next(new) if ok else "" for ok in told]
            others, passages = ask(VARIANTS, texts), ask(PASSAGE, texts) if dense else [""] * len(texts)
            lists = []
            for text, again, more, passage in zip(texts, rewritten, others, passages, strict=True):
                all_ = [("question", text), *[("rewriting", again)] * (len(again) > 3), *[("variant", x) for x in string_list(more)[:variants]], *[("passage", passage)] * bool(passage)]
                first: dict[str, str] = {}
                for kind, x in all_:
                    first.setdefault(x, kind)
                lists.append([{"kind": kind, "text": x} for x, kind in first.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])))], names=["query_id", "texts"])

    kind = queries.schema["query_id"].dataType.simpleString()
    rows = queries.select("query_id", "text", "history").mapInArrow(run, f"query_id {kind}, texts array<struct<kind:string,text:string>>")
    return rows.select("query_id", F.posexplode("texts").alias("nth", "x")).select("query_id", "nth", "x.kind", "x.text")


FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)


def strip_reasoning(text: str, script: str | None = None) -> str:
    """Without think blocks, closed or not, and without white space in front.

    A text that is a JSON array is left as it is, and so is what stands in code fences.  With ``script`` (a character class, say ``"\u0400-\u04FF"``)
    paragraphs before the first one in that script are taken for reasoning too, if there is such a paragraph.
    """
    if text.strip().startswith("[") and text.strip().endswith("]"):
        try:
            json.loads(text)
            return text.lstrip()
        except ValueError:  # only looks like a list, as "[1] ... [2]" does
            pass
    fences: list[str] = []

    def mask(found: re.Match) -> str:
        fences.append(found[0])
        return f"\0{len(fences) - 1}\0"

    bare = text if "\0" in text else FENCE.sub(mask, text)
    bare = re.sub(r"<think>.*?(?:</think>|\Z)", "", bare, flags=re.S | re.I)
    if script:
        parts = re.split(r"(\n\s*\n)", bare)
        at = next((i for i, part in enumerate(parts) if re.search(f"[{script}]", part)), 0)
        bare = "".join(parts[at:])
    return (re.sub("\0(\\d+)\0", lambda found: fences[int(found[1])], bare) if fences else bare).lstrip()
