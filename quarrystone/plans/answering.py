"""From a question to an answer: prefixes of chunks, prompts, generation, verification, and versioned index builds."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.config import Settings
from quarrystone.functions.models import Embedder, Generator, embed, string_list, strip_reasoning
from quarrystone.operators import context
from quarrystone.operators.manifest import build_manifest
from quarrystone.session import prepare

#: How each answer mode asks to be answered.
MODES = {
    "default": "Answer from the passages below.",
    "short": "Answer in at most three sentences, from the passages below.",
    "detailed": "Answer in full, from the passages below, and name the passages.",
    "steps": "Answer as numbered steps, from the passages below.",
    "table": "Answer as a table, from the passages below.",
    "quote": "Answer with quotations from the passages below only.",
}


def embed_text(prefix: Column, body: Column) -> Column:
    """What is embedded: the prefix, a blank line and the body; the body alone without a prefix."""
    return F.when(F.trim(F.coalesce(prefix, F.lit(""))) != "", F.concat(prefix, F.lit("\n\n"), body)).otherwise(body)


def generate(rows: DataFrame, generator: Generator, key: str, prompt: str = "prompt", out: str = "answer") -> DataFrame:
    """(key, out): a generator's text for every prompt, without its reasoning."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [strip_reasoning(a or "") for a in generator([p or "" for p in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string())], names=[key, out])

    return rows.select(key, prompt).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {out} string")


def contextual_prefixes(chunks: DataFrame, generator: Generator, key: str, first: int = 80, shortest: int = 40) -> DataFrame:
    """(key, prefix) of the first chunks of each document that are long enough: the answer's first line, clipped."""
    asked = chunks.filter((F.col("chunk_index") < first) & (F.length("text") >= shortest))
    prompt = F.concat(F.lit("Situate this passage of "), F.coalesce("title", F.lit("a document")), F.lit(":\n"), F.substring("text", 1, 900))
    told = generate(asked.withColumn("prompt", prompt), generator, key, out="prefix")
    return told.withColumn("prefix", F.substring(F.trim(F.element_at(F.split("prefix", "\n"), 1)), 1, 500))


def prompts(packed: DataFrame, queries: DataFrame, mode: str = "default", history: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt) of every question; one without passages says so."""
    told = queries.join(context.context_text(packed), "query_id", "left")
    past = F.lit("")
    if history is not None:
        told = told.join(history.select("query_id", "history"), "query_id", "left")
        past = F.coalesce(F.concat(F.lit("Conversation so far:\n"), F.col("history"), F.lit("\n\n")), F.lit(""))
    passages = F.coalesce("context", F.lit("(no passages were found)"))
    return told.select("query_id", F.concat(F.lit(MODES.get(mode, MODES["default"]) + "\n\n"), past, passages, F.lit("\n\nQuestion: "), F.col("text")).alias("prompt"))


def answer(found: DataFrame, queries: DataFrame, generator: Generator, settings: Settings | None = None, mode: str = "default", judged: bool = False, further: int = 0) -> DataFrame:
    """(query_id, answer, n_sources, footer): the whole way from retrieved documents to a cited answer.

    ``judged`` adds the generator's verdict on each answer and its citations, ``further`` up to so many questions that could follow.
    """
    packed = context.packed_context(found.withColumn("label", context.source_label("source", "title")), settings)
    told = generate(prompts(packed, queries, mode), generator, "query_id")
    quoted = context.citations(told, found)
    cited = quoted.join(found.select("query_id", "position", F.col("source").alias("label"), "score"), ["query_id", "position"])
    footer = context.citation_footer(cited, settings)
    sources = found.groupBy("query_id").agg(F.count("*").alias("n_sources"))
    out = told.join(sources, "query_id", "left").join(footer, "query_id", "left").select("query_id", "answer", F.coalesce("n_sources", F.lit(0)).alias("n_sources"), "footer")
    if judged:
        out = out.join(verdicts(told, quoted, generator), "query_id", "left")
    if further:
        asked = follow_ups(told, generator, further).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "question"))), lambda x: x["question"]).alias("follow_ups"))
        out = out.join(asked, "query_id", "left").withColumn("follow_ups", F.coalesce("follow_ups", F.array().cast("array<string>")))
    return out


#: What a reader of an answer is told of each source, with what stands where the source lacks it.
SHOWN = {"title": "Untitled", "path": "N/A", "source": None, "chunk_id": None, "text": "", "file_type": "", "chunk_index": None, "total_chunks": None, "section_path": "", "chunk_kind": ""}


def results(answers: DataFrame, found: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, answer, sources, citations): one row a question, as a reader takes it.

    ``sources`` are structs of ``SHOWN`` with score and relevance, by position; columns that ``found`` lacks are filled, and a source without a name
    has its title.  ``citations`` are structs (text, source, chunk_id, score).
    """
    has = lambda rows, name: F.col(name) if name in rows.columns else F.lit(None)
    title = F.coalesce(has(found, "title").cast("string"), F.lit(SHOWN["title"]))
    told = {name: F.coalesce(has(found, name), title if name == "source" else F.lit(default)) if default is not None or name == "source" else has(found, name) for name, default in SHOWN.items()}
    shown = F.struct("position", *[c.cast("string").alias(name) for name, c in told.items()], F.col("score"), F.round("score", 2).alias("relevance"))
    sources = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x.dropFields("position")).alias("sources"))
    quote = F.struct("position", F.col("citation").alias("text"), has(cited, "label").cast("string").alias("source"), has(cited, "chunk_id").cast("string").alias("chunk_id"), F.round(has(cited, "score").cast("double"), 2).alias("score"))
    quotes = cited.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(quote)), lambda x: x.dropFields("position")).alias("citations"))
    rows = answers.select("query_id", "answer").join(sources, "query_id", "left").join(quotes, "query_id", "left")
    return rows.select("query_id", "answer", F.coalesce("sources", F.array().cast(sources.schema["sources"].dataType)).alias("sources"), F.coalesce("citations", F.array().cast(quotes.schema["citations"].dataType)).alias("citations"))


def verdicts(answers: DataFrame, cited: DataFrame, generator: Generator, most: int = 8) -> DataFrame:
    """(query_id, verdict): a generator's verdict on an answer and its citations; ``no_sources`` without any, ``partial`` for one that
    can't be read."""
    lists = cited.filter(F.col("position") <= most).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list(F.substring("citation", 1, 1200))), "\n").alias("sources"))
    both = answers.join(lists, "query_id", "left")
    asked = both.filter("sources IS NOT NULL").withColumn("prompt", F.concat(F.lit("Is this answer supported? Reply in JSON.\n"), F.col("answer"), F.lit("\n"), F.col("sources")))
    told = generate(asked, generator, "query_id", out="reply").withColumn("verdict", F.coalesce(F.get_json_object(F.regexp_extract("reply", r"(?s)(\{.*\})", 1), "$.verdict"), F.lit("partial")))
    return both.select("query_id").join(told.select("query_id", "verdict"), "query_id", "left").select("query_id", F.coalesce("verdict", F.lit("no_sources")).alias("verdict"))


def follow_ups(answers: DataFrame, generator: Generator, most: int = 5) -> DataFrame:
    """(query_id, nth, question): up to five further questions, each clipped, none twice."""
    told = generate(answers.withColumn("prompt", F.concat(F.lit("Suggest further questions as a JSON array.\n"), F.col("answer"))), generator, "query_id", out="reply")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [list(dict.fromkeys(x[:120] for x in string_list(reply)))[:most] for reply in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string()))], names=["query_id", "questions"])

    kind = told.schema["query_id"].dataType.simpleString()
    return told.mapInArrow(read, f"query_id {kind}, questions array<string>").select("query_id", F.posexplode("questions").alias("nth", "question"))


def answer_events(answers: DataFrame, key: str = "query_id", size: int = 200) -> DataFrame:
    """(key, seq, type, payload): what a reader of a streamed answer sees, in order of seq: its status, the answer in deltas of at
    most ``size`` characters and, when it is whole, done with their number; an error instead for an answer that is null or blank."""
    event = lambda kind, payload: F.struct(F.lit(kind).alias("type"), payload.alias("payload"))
    deltas = F.transform(F.regexp_extract_all("answer", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), lambda d: event("delta", d))
    whole = F.concat(F.array(event("status", F.lit("answering"))), deltas, F.array(event("done", F.size(deltas).cast("string"))))
    failed = F.array(event("status", F.lit("answering")), event("error", F.lit("no answer")))
    rows = answers.select(key, F.posexplode(F.when(F.trim(F.coalesce("answer", F.lit(""))) != "", whole).otherwise(failed)).alias("seq", "event"))
    return rows.select(key, "seq", "event.type", "event.payload")


def build_index(spark: SparkSession, root: str, files: DataFrame, chunks: DataFrame, embedder: Embedder, settings_hash: str = "") -> str:
    """Write chunks, vectors and manifest as a new version below ``root`` and return its folder.

    Nothing of an older version is touched.  The counts must agree before the caller moves the pointer (``store.publish``).
    """
    version = f"{root.rstrip('/')}/version-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{version}/chunks", compression="zstd")
    stored = spark.read.parquet(f"{version}/chunks")
    embed(stored.withColumnRenamed("chunk_id", "key"), embedder).withColumnRenamed("key", "chunk_id").write.parquet(f"{version}/vectors", compression="zstd")
    build_manifest(files, stored, settings_hash).write.parquet(f"{version}/manifest", compression="zstd")
    n_chunks, n_vectors = (spark.read.parquet(f"{version}/{part}").count() for part in ("chunks", "vectors"))
    if n_chunks != n_vectors:
        raise RuntimeError(f"{n_vectors} vectors for {n_chunks} chunks: the version is not published")
    return version


class TemplateGenerator:
    """Repeats the first passage of a prompt; verdicts and lists in JSON where they are asked for."""

    def __call__(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            if p.startswith("Is this answer supported?"):
                out.append(json.dumps({"verdict": "supported"}))
            elif p.startswith("Suggest further questions"):
                out.append(json.dumps(re.findall(r"\w{5,}", p)[3:8]))
            else:
                passage = re.search(r"\[[^\]]*\]\n(.*?)\n", p, re.S)
                out.append("<think>reading</think>" + (passage[1] if passage else p.split("\n")[-1]))
        return out
