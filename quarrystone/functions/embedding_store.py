"""Embeddings kept between runs: generations of entries below a pointer, with a time to live and a capacity.

A run embeds only texts whose entry is missing or too old, and writes its new entries, the keys that it used and the keys that the capacity
pushed out as tables of their own; nothing else is written.  Entries are a join of these: made last and not pushed out since, no older than the
time to live, used last when the last run that wanted them ran.  Many small tables are written as one now and then.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone import store
from quarrystone.functions.models import Embedder, embed

ENTRIES = "key string, embedding array<float>, created bigint"
USED = "key string, used bigint"
OUT = "key string, created bigint"
#: Generations that are written as one when there are more.
MOST_GENERATIONS = 12


def _tables(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _state(spark: SparkSession, root: str) -> dict:
    return json.loads(store.current(spark, root) or '{"entries": [], "used": [], "out": []}')


def entries(spark: SparkSession, root: str, now: int, ttl: int) -> DataFrame:
    """(key, embedding, created, used) of all that is kept and not older than ``ttl`` seconds ``now``."""
    return _entries(spark, _state(spark, root), now, ttl)


def _entries(spark: SparkSession, state: dict, now: int, ttl: int) -> DataFrame:
    live = _tables(spark, state["entries"], ENTRIES).filter(F.col("created") > now - ttl)
    live = live.join(_tables(spark, state["out"], OUT), ["key", "created"], "left_anti")
    return live.join(_tables(spark, state["used"], USED).groupBy("key").agg(F.max("used").alias("used")), "key")


def pushed_out(kept: DataFrame, capacity: int) -> DataFrame:
    """(key, created) of entries beyond the ``capacity``: those used longest ago, of one moment the greatest keys.

    Moments are runs, so their counts are few; only the entries of the one moment that the capacity cuts are put in order.
    """
    counts = sorted(kept.groupBy("used").count().collect(), reverse=True)  # a row a run
    room = capacity
    for moment, n in counts:
        if n > room:
            last = kept.filter(F.col("used") == moment).select("key", "created").orderBy("key").limit(room)
            beyond = kept.filter(F.col("used") == moment).select("key", "created").join(last, ["key", "created"], "left_anti")
            return beyond.unionByName(kept.filter(F.col("used") < moment).select("key", "created"))
        room -= n
    return kept.limit(0).select("key", "created")


def embedded(spark: SparkSession, root: str, texts: DataFrame, embedder: Embedder, model: str, now: int, ttl: int, capacity: int) -> tuple[DataFrame, dict[str, int]]:
    """(key, embedding) of the distinct texts, and how many were found and how many embedded.

    Keys are digests of model and text.  Two runs at once don't lose each other's entries: the one that ends last gets ``store.Conflict``,
    and can be run again.  A text that can't be embedded fails the run, which then has changed nothing.
    """
    root = root.rstrip("/")
    started, state = store.last(spark, root), _state(spark, root)
    folder = f"{root}/run-{uuid.uuid4().hex}"
    wanted = texts.select("text").filter("text IS NOT NULL").distinct().select(F.sha2(F.concat_ws(":", F.lit(model), "text"), 256).alias("key"), "text")
    live = _entries(spark, state, now, ttl)
    missing = wanted.join(live.select("key"), "key", "left_anti")
    embed(missing, embedder).withColumn("created", F.lit(now).cast("bigint")).write.parquet(f"{folder}/entries")
    wanted.select("key", F.lit(now).cast("bigint").alias("used")).write.parquet(f"{folder}/used")
    new = spark.read.schema(ENTRIES).parquet(f"{folder}/entries")
    after = {"entries": [*state["entries"], f"{folder}/entries"], "used": [*state["used"], f"{folder}/used"], "out": list(state["out"])}
    kept = _entries(spark, after, now, ttl)
    pushed_out(kept.select("key", "created", "used"), capacity).write.parquet(f"{folder}/out")
    after["out"].append(f"{folder}/out")
    if len(after["entries"]) > MOST_GENERATIONS:
        whole = _entries(spark, after, now, ttl)
        whole.select("key", "embedding", "created").write.parquet(f"{folder}/whole")
        whole.select("key", "used").write.parquet(f"{folder}/whole-used")
        after = {"entries": [f"{folder}/whole"], "used": [f"{folder}/whole-used"], "out": []}
    store.publish(spark, root, json.dumps(after), after=started)
    found = live.join(wanted.select("key"), "key", "left_semi").select("key", "embedding")
    n_new, n_used = new.count(), spark.read.parquet(f"{folder}/used").count()
    return found.unionByName(new.select("key", "embedding")), {"found": n_used - n_new, "embedded": n_new}
