"""A store of rows by id that lookups read little of: parts by a hash of the id, sorted, with bloom filters in their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: About so many rows a part.
PART_ROWS = 200_000
#: Up to so many ids are put into the plan, which then names the parts to be read; more are joined.
FEW_IDS = 10_000


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_store(rows: DataFrame, folder: str, key: str, parts: int | None = None) -> None:
    """Write rows as a folder a part; a part is one file, unless many rows share an id.  Rows without an id can't be asked for and are left out."""
    known = rows.filter(F.col(key).isNotNull())
    parts = parts or max(1, -(-known.count() // PART_ROWS))
    dealt = known.withColumn("part", part_of(F.col(key), parts)).repartition("part").sortWithinPartitions("part", key)
    filters = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(PART_ROWS)}
    dealt.write.mode("overwrite").options(**filters).partitionBy("part").parquet(f"{folder}/rows")
    rows.sparkSession.createDataFrame([(key, parts)], "key string, parts int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/shape")


def by_ids(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The stored rows of ``wanted`` (key, position), with their position; ids that the store lacks drop out, and an id that is wanted twice
    comes twice.  The caller orders by position.

    Few ids name the parts and, through statistics and bloom filters, the row groups that are read.  Many are joined by part and id.
    """
    key, parts = spark.read.parquet(f"{folder}/shape").first()
    rows = spark.read.parquet(f"{folder}/rows")
    asked = wanted.select(F.col(key), "position").filter(F.col(key).isNotNull())
    few = asked.select(key).distinct().limit(FEW_IDS + 1).withColumn("part", part_of(F.col(key), parts)).collect()
    if len(few) <= FEW_IDS:
        needed = sorted({r["part"] for r in few})
        rows = rows.filter(F.col("part").isin(needed) & F.col(key).isin([r[key] for r in few])) if few else rows.limit(0)
        return rows.drop("part").join(F.broadcast(asked.limit(FEW_IDS)) if asked.limit(FEW_IDS + 1).count() <= FEW_IDS else asked, key)
    return rows.join(asked.withColumn("part", part_of(F.col(key), parts)), ["part", key]).drop("part")
