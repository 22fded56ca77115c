"""The chat history as stored tables: users, sessions, messages and feedback, each version of all four behind one pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarrystone import store
from quarrystone.operators.history_writes import FEEDBACK, MESSAGES, SESSIONS, SORTED_BY, USERS, with_schema

SCHEMAS = {"users": USERS, "sessions": SESSIONS, "messages": MESSAGES, "feedback": FEEDBACK}


def read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables as the pointer has them now; those that were never written are empty, and columns that a table lacks are null."""
    paths = json.loads(store.current(spark, root) or "{}")
    return {name: with_schema(spark.read.parquet(paths[name]), schema) if name in paths else spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def write(spark: SparkSession, root: str, changed: dict[str, DataFrame], after: int | None = None) -> int:
    """Store the changed tables, sorted for their readers, and publish them with the others as they are; returns the version's number.

    A writer that was overtaken, since ``after`` (the number that its changes were made from) or since this call began, gets ``store.Conflict``
    and has changed nothing.
    Tables may be made from those that ``read`` gave, as nothing that an older version names is written again.
    """
    unknown = set(changed) - set(SCHEMAS)
    if unknown:
        raise ValueError(f"no such tables: {sorted(unknown)}")
    after = store.last(spark, root) if after is None else after
    folder = f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"
    for name, table in changed.items():
        with_schema(table, SCHEMAS[name]).repartitionByRange(*SORTED_BY[name]).sortWithinPartitions(*SORTED_BY[name]).write.parquet(f"{folder}/{name}")
    paths = json.loads(store.current(spark, root) or "{}") | {name: f"{folder}/{name}" for name in changed}
    return store.publish(spark, root, json.dumps(paths), after)
