"""What a session needs before Python workers run the library's functions."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Temporary folders of local sessions without a checkpoint folder, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or ``spark.quarrystone.dir`` where that is unset.

    Without either, a local session gets a temporary folder of this machine; on a cluster that is an error, since every executor
    would write to its own disk.
    """
    context = spark.sparkContext
    for name in ("spark.checkpoint.dir", "spark.quarrystone.dir"):
        path = context.getConf().get(name) or spark.conf.get(name, None)
        if path:
            return path.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir (or spark.quarrystone.dir) to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quarrystone-")
    return _LOCAL[context.applicationId]


def checkpoint_dir(spark: SparkSession) -> str:
    """``shared_dir``, made the folder of ``DataFrame.checkpoint`` where the session has none."""
    path = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def prepare(spark: SparkSession, batch_rows: int | None = None) -> None:
    """Let Python workers on this machine import the library, and bound the rows of an Arrow batch.

    A cluster gets the package as any other (installed, or through --py-files); the path only adds to that.
    """
    root = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [*paths, root]))
    if batch_rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
