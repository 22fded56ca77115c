"""Versions below a folder that all machines share, and the lease of the one job that may make the next: each appears whole and in one step."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is absent."""
    system, target = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(target)) if system.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nobody reads."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


class Conflict(RuntimeError):
    """Somebody else was first; nothing was changed."""


def claim(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with its whole content in one step, or tell that there is one already.

    The content is written aside.  A local file then appears by a hard link, which fails where the name exists; in other file systems by a
    rename of the file, which their name service refuses onto an existing one.
    """
    system, target = _file_system(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}-aside/{uuid.uuid4().hex}")
    system.mkdirs(target.getParent())
    out = system.create(aside, False)
    out.write(content.encode())
    out.close()
    try:
        if system.getUri().getScheme() != "file":
            return not system.exists(target) and system.rename(aside, target)
        place = lambda p: spark._jvm.java.nio.file.Path.of(p.toUri().getPath(), spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0))
        spark._jvm.java.nio.file.Files.createLink(place(target), place(aside))
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        system.delete(aside, False)


def publish(spark: SparkSession, root: str, value: str, after: int | None = None, most_tries: int = 20) -> int:
    """Make ``value`` the current one and return its number.

    A pointer is one file whose name is the next number and which is claimed in one step: at any moment the pointer is the old or the
    new one, and readers that took the old one keep it.  Of two writers one gets the next number after; with ``after``, the number that a
    writer started from, it gets ``Conflict`` instead if another was current meanwhile, so that nothing of that is lost.
    """
    root = root.rstrip("/")
    for _ in range(most_tries):
        number = last(spark, root)
        if after is not None and number != after:
            raise Conflict(f"{root} is at {number}, not at {after}")
        if claim(spark, f"{root}/pointers/{number + 1:012d}", value):
            return number + 1
    raise RuntimeError(f"no pointer could be written below {root}")


def last(spark: SparkSession, root: str) -> int:
    """The number of the current pointer, 0 before the first."""
    return max((int(x) for x in children(spark, f"{root.rstrip('/')}/pointers") if x.isdigit()), default=0)


def current(spark: SparkSession, root: str) -> str | None:
    """The current value, or none before the first."""
    number = last(spark, root)
    return _read(spark, f"{root.rstrip('/')}/pointers/{number:012d}") if number else None


def _read(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


class Busy(RuntimeError):
    """Another job holds the lease."""


@dataclass(frozen=True)
class Lease:
    """The right to be the one active job below ``root``, until ``until`` (seconds since the epoch).  ``number`` only ever rises: whoever holds a
    lower one has lost the lease."""

    root: str
    owner: str
    number: int
    until: float

    @staticmethod
    def _state(spark: SparkSession, root: str) -> tuple[int, dict]:
        held = [int(x) for x in children(spark, f"{root}/leases") if x.isdigit()]
        number = max(held, default=0)
        return number, json.loads(_read(spark, f"{root}/leases/{number:012d}")) if number else {"owner": None, "until": 0}

    @staticmethod
    def acquire(spark: SparkSession, root: str, owner: str, seconds: float, now: float | None = None) -> Lease:
        """Take the lease if nobody holds it or its time is over; ``Busy`` otherwise, also for the slower of two at the same moment."""
        root, now = root.rstrip("/"), time.time() if now is None else now
        number, state = Lease._state(spark, root)
        if state["until"] > now:
            raise Busy(f"{state['owner']} is active until {state['until']:.0f}")
        return Lease._next(spark, root, owner, number, now + seconds)

    @staticmethod
    def _next(spark: SparkSession, root: str, owner: str, number: int, until: float) -> Lease:
        if not claim(spark, f"{root}/leases/{number + 1:012d}", json.dumps({"owner": owner, "until": until})):
            raise Busy(f"another job took the lease of {root}")
        return Lease(root, owner, number + 1, until)

    def renewed(self, spark: SparkSession, seconds: float, now: float | None = None) -> Lease:
        """The lease for a further time; ``Busy`` if it was lost meanwhile, whoever has it now."""
        return self._next(spark, self.root, self.owner, self.number, (time.time() if now is None else now) + seconds)

    def release(self, spark: SparkSession) -> None:
        """Let the next job begin; nothing happens if the lease was lost already."""
        claim(spark, f"{self.root}/leases/{self.number + 1:012d}", json.dumps({"owner": self.owner, "until": 0}))
