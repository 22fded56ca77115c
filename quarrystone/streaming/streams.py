"""Streams: offset-committed event intake, incremental corpus maintenance and reasoning filters, on Structured Streaming."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrystone import store
from quarrystone.operators.chunking import fixed_chunks
from quarrystone.session import prepare, shared_dir


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints that the cluster shares."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 4) -> DataFrame:
    """A table's files as a stream, a few files a batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true")
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def parsed_events(events: DataFrame, kinds: list[str], body: str, schema: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """Events of the given kinds whose body and ``needed`` columns are there, with the body's fields (null where it can't be read)."""
    kept = F.col("event_type").isin(*kinds) & F.col(body).isNotNull()
    for name in needed:
        kept &= F.col(name).isNotNull()
    return events.filter(kept).withColumn("_body", F.from_json(body, schema)).select("*", "_body.*").drop("_body")


def take_events(events: DataFrame, folder: str, bad: Column, parse: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> None:
    """Read all events there are: accepted ones go to ``accepted``, those that ``bad`` (over the parsed columns; null is no) tells to ``dead``.

    The stream's checkpoint commits offsets after each batch; a batch that is repeated after a crash overwrites its own files, so
    each event is kept once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        parsed = parse(batch).withColumn("_bad", F.coalesce(bad, F.lit(False))).persist()  # read and parsed once for both
        for name, kept in (("accepted", ~F.col("_bad")), ("dead", F.col("_bad"))):
            parsed.filter(kept).drop("_bad").write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        parsed.unpersist()

    query = events.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()


#: A part of a maintained corpus that holds so many chunks is left as it is; smaller ones are written as one now and then.
PART_CHUNKS = 200_000
#: So many parts (or tables of documents that came again) of one step of size are written as one; a step is a factor.
MERGED, STEP = 4, 4
#: Up to so many documents are broadcast.
BROADCAST_DOCUMENTS = 500_000
MAINTAINED = "doc_id bigint, chunk_index int, start int, text string"
GONE = "part string, doc_id bigint, chunks bigint"


def _parts(spark: SparkSession, folder: str) -> dict:
    """What the pointer holds: the last batch, how many parts there are, for each the chunks written in it and those that still count, and the
    tables of documents whose chunks in a part don't count any more, with their rows of each part."""
    told = json.loads(store.current(spark, folder) or '{"batch": -1, "ways": 0, "parts": {}, "gone": {}}')
    if "gone" not in told:  # written when a part was what its last batch made of it
        told |= {"parts": {f"batch={number}/part={k}": [n, n] for k, (number, n) in told["parts"].items()}, "gone": {}}
    return told


def _counting(spark: SparkSession, folder: str, told: dict, names: list[str]) -> DataFrame:
    """The chunks of some parts that still count, each with its ``part``."""

    def read(some: list[str]) -> DataFrame:
        rows = spark.read.schema(MAINTAINED).parquet(*[f"{folder}/data/{name}" for name in some]) if some else spark.createDataFrame([], MAINTAINED)
        return rows.withColumn("part", F.regexp_extract("_metadata.file_path", ".*/data/(.+)/[^/]+$", 1) if some else F.lit(""))

    left = [name for name in names if told["parts"][name][0] > told["parts"][name][1]]  # parts that have lost chunks
    if not left:
        return read(names)
    tables = [name for name, rows in told["gone"].items() if set(rows) & set(left)]
    gone = spark.read.schema(GONE).parquet(*[f"{folder}/gone/{name}" for name in tables]).filter(F.col("part").isin(left)).select("part", "doc_id")
    few = sum(rows.get(name, 0) for rows in told["gone"].values() for name in left) <= BROADCAST_DOCUMENTS
    rest = read(left).join(F.broadcast(gone) if few else gone, ["part", "doc_id"], "left_anti").select(*gone.columns, "chunk_index", "start", "text")
    whole = [name for name in names if name not in left]
    return read(whole).unionByName(rest) if whole else rest


def maintained_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus that ``maintain_chunks`` keeps in a folder, as its pointer has it now."""
    told = _parts(spark, folder)
    return _counting(spark, folder, told, list(told["parts"])).select("doc_id", "chunk_index", "start", "text")


def _alike(sizes: dict[str, int]) -> list[str]:
    """Names of one step of size, the smallest first, where there are ``MERGED`` of them."""
    steps: dict[int, list[str]] = {}
    for name, n in sizes.items():
        steps.setdefault(int(log(max(1, n), STEP)), []).append(name)
    return next((names for _, names in sorted(steps.items()) if len(names) >= MERGED), [])


def maintain_chunks(documents: DataFrame, folder: str, part_chunks: int = PART_CHUNKS) -> DataFrame:
    """Upsert the chunks of arriving documents; returns the corpus after all there are.

    A batch writes its own chunks as a new part, and a row for each document that older parts hold chunks of; then it moves the stored pointer, so
    readers see it whole or not at all.  Chunks of other documents are not written again, but where parts of fewer than ``part_chunks`` are
    written as one (a chunk so about once for each step of size below that) or a part is mostly gone, and texts are shuffled only where a
    document comes twice in a batch.
    It can be started again on the same folder at any time: the stream goes on behind its checkpoint, and a batch that the pointer
    already holds is not applied twice.  Of a document that comes twice in a batch the greatest text counts.
    """
    spark = documents.sparkSession
    prepare(spark, 512)

    def upsert(batch: DataFrame, number: int) -> None:
        told = _parts(spark, folder)
        if number <= told["batch"]:
            return
        ids = batch.groupBy("doc_id").agg(F.count("*").alias("rows")).persist()
        n, most, least, greatest = ids.agg(F.count("*"), F.max("rows"), F.min("doc_id"), F.max("doc_id")).first()
        one = batch.groupBy("doc_id").agg(F.max("text").alias("text")) if (most or 0) > 1 else batch
        parts, gone, new = dict(told["parts"]), dict(told["gone"]), f"batch={number}"
        fixed_chunks(one).write.mode("overwrite").parquet(f"{folder}/data/{new}")
        if parts and least is not None:
            known = ids.select("doc_id")
            older = _counting(spark, folder, told, list(parts)).filter(F.col("doc_id").between(least, greatest)).select("part", "doc_id")
            again = older.join(F.broadcast(known) if n <= BROADCAST_DOCUMENTS else known, "doc_id", "left_semi").groupBy("part", "doc_id").agg(F.count("*").alias("chunks"))
            again.write.mode("overwrite").parquet(f"{folder}/gone/{new}")
            lost = {r["part"]: r for r in spark.read.schema(GONE).parquet(f"{folder}/gone/{new}").groupBy("part").agg(F.count("*").alias("rows"), F.sum("chunks").alias("less")).collect()}  # a row a part
            parts = {name: [held, left - (lost[name]["less"] if name in lost else 0)] for name, (held, left) in parts.items()}
            gone |= {new: {name: r["rows"] for name, r in lost.items()}} if lost else {}
        ids.unpersist()
        held = spark.read.schema(MAINTAINED).parquet(f"{folder}/data/{new}").count()
        told = _merged(spark, folder, {"batch": number, "parts": parts | {new: [held, held]}, "gone": gone}, part_chunks)
        store.publish(spark, folder, json.dumps(told | {"ways": len(told["parts"])}))

    query = documents.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return maintained_chunks(spark, folder)


def _merged(spark: SparkSession, folder: str, told: dict, part_chunks: int) -> dict:
    """What a pointer is to hold, after small parts of one step of size were written as one and those that are mostly gone anew; then the tables of
    what is gone."""
    times = 0
    while True:
        parts = {name: sizes for name, sizes in told["parts"].items() if sizes[1]}
        gone = {table: listed for table, rows in told["gone"].items() if (listed := {name: n for name, n in rows.items() if name in parts})}
        told, new = told | {"parts": parts, "gone": gone}, f"batch={told['batch']}-{times}"
        chosen = _alike({name: left for name, (_, left) in parts.items() if left < part_chunks}) or [name for name, (held, left) in parts.items() if 2 * left < held][:1]
        tables = [] if chosen else _alike({table: sum(rows.values()) for table, rows in gone.items()})
        if chosen:
            n = sum(parts[name][1] for name in chosen)
            _counting(spark, folder, told, chosen).drop("part").coalesce(max(1, n // part_chunks)).write.mode("overwrite").parquet(f"{folder}/data/{new}")
            told["parts"] = {name: sizes for name, sizes in parts.items() if name not in chosen} | {new: [n, n]}
        elif tables:
            listed = Counter()
            for table in tables:
                listed.update(gone[table])
            rows = spark.read.schema(GONE).parquet(*[f"{folder}/gone/{table}" for table in tables]).filter(F.col("part").isin(list(parts)))
            rows.coalesce(max(1, sum(listed.values()) // BROADCAST_DOCUMENTS)).write.mode("overwrite").parquet(f"{folder}/gone/{new}")
            told["gone"] = {table: rows for table, rows in gone.items() if table not in tables} | {new: dict(listed)}
        else:
            return told
        times += 1


class ProgressLog(StreamingQueryListener):
    """A row for each batch of every stream of the session: (query, name, batch, rows, seconds, offset), and why a stream ended."""

    def __init__(self, spark: SparkSession):
        self.spark, self.batches, self.ended = spark, [], []

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *told) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        offset = p.sources[0].endOffset if p.sources else None
        self.batches.append((str(p.runId), p.name, p.batchId, p.numInputRows, p.batchDuration / 1000, offset))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append((str(event.runId), event.exception))

    def rows(self) -> DataFrame:
        return self.spark.createDataFrame(self.batches, "query string, name string, batch bigint, rows bigint, seconds double, offset string")


OPEN, CLOSE = "<think>", "</think>"


def shown_part(inside: bool, tail: str, started: bool, piece: str) -> tuple[bool, str, bool, str]:
    """What a further piece of text adds to the visible text, and the state after it: whether a think block is open, the last few
    characters (a mark can be split between pieces), and whether anything but white space was shown."""
    text, out = tail + piece, []
    at = len(tail)  # shown or passed over so far; a mark may begin before it
    scan = 0
    while True:
        mark = CLOSE if inside else OPEN
        found = text.lower().find(mark, scan)
        if found < 0:
            break
        if not inside:
            out.append(text[at : max(at, found)])
        scan = at = found + len(mark)
        inside = not inside
    at = max(at, scan)
    if not inside:
        out.append(text[at:])
    shown = "".join(out)
    if not started:
        shown = shown.lstrip()
    keep = max(scan, len(text) - len(CLOSE) + 1)
    return inside, text[keep:], started or bool(shown), shown


def visible_text(pieces: DataFrame, idle: str | None = None) -> DataFrame:
    """(exchange, shown) of a stream of (exchange, seq, piece): what each batch adds to the text without reasoning.

    The state of an exchange is a few characters, whatever its length.  With ``idle`` ("1 hour") it is dropped when nothing has
    come for so long; that is for streams that go on, since one that ends with what there is would wait for it.  A part of a mark
    that was shown before the rest of it came is not taken back.
    """
    prepare(pieces.sparkSession)
    wait = idle and int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        inside, tail, started = state.get if state.exists else (False, "", False)
        new = pd.concat(list(frames)).sort_values("seq")
        inside, tail, started, shown = shown_part(inside, tail, started, "".join(new["piece"]))
        state.update((inside, tail, started))
        if wait:
            state.setTimeoutDuration(wait)
        if shown:
            yield pd.DataFrame({"exchange": [key[0]], "shown": [shown]})

    return pieces.groupBy("exchange").applyInPandasWithState(step, "exchange bigint, shown string", "inside boolean, tail string, started boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)
