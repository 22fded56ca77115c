"""Names that hold one another, found by equality joins on their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts_of(name: Column, lengths: Column) -> Column:
    """The distinct parts of a name that have one of the lengths."""
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda at: F.substring(name, at, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: (n > 0) & (n <= F.length(name))), starts)))


def lookup_names(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(label, source) for each of ``wanted`` (label) the one of ``known`` (source) that equals it without regard to case, else the
    shortest that holds it or is held by it; labels that match nothing have no row, and empty names match nothing.

    A name can only hold another if it has a part that equals it, so both sides are exploded to parts of the lengths that occur on the
    other side: no pair is looked at that has nothing in common.
    """
    name = F.lower("label")
    lengths = lambda table, c: F.broadcast(table.agg(F.collect_set(F.length(c)).alias("lengths")))  # noqa: E731  (one row; names are short)
    held = known.join(lengths(wanted, F.col("label"))).select("source", F.explode(parts_of(F.col("source"), F.col("lengths"))).alias("name"))
    holding = wanted.select("label", name.alias("name")).join(lengths(known, F.col("source"))).select("label", F.explode(parts_of(F.col("name"), F.col("lengths"))).alias("source"))
    near = wanted.select("label", name.alias("name")).join(held, "name").select("label", "source")
    near = near.unionByName(holding.join(known, "source").select("label", "source"))
    best = F.struct(F.when(name == F.col("source"), 0).otherwise(1), F.length("source"), "source")
    return near.groupBy("label").agg(F.min_by("source", best).alias("source"))
