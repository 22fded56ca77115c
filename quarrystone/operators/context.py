"""From retrieved documents to an answer's context: packing, citations and source cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.config import Settings
from quarrystone.functions.text import collapse, first_filled, sentences

SEPARATOR = "\n---\n"


def source_label(*columns: str, limit: int = 220) -> Column:
    return F.substring(F.coalesce(first_filled(*columns), F.lit("N/A")), 1, limit)


def packed_context(found: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Rows (query_id, position, label, text) that fit the budget, with the block that goes into the prompt.

    Blocks are taken while their running length fits.  The first that doesn't is cut to what remains, if that is over 50
    characters; nothing follows it.  Separators don't count.
    """
    s = settings or Settings()
    rows = found.withColumn("block", F.concat(F.lit("["), F.col("label"), F.lit("]\n"), F.col("text"), F.lit("\n"))).withColumn("length", F.length("block"))
    upto = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("total", F.sum("length").over(upto))
    left = s.max_context_chars - (F.col("total") - F.col("length"))
    cut = (F.col("total") > s.max_context_chars) & (left > 50)
    block = F.when(cut, F.concat(F.substring(F.col("block"), F.lit(1), left.cast("int")), F.lit("..."))).otherwise(F.col("block"))
    return rows.filter((F.col("total") <= s.max_context_chars) | cut).select("query_id", "position", block.alias("block"), cut.alias("truncated"))


def context_text(packed: DataFrame) -> DataFrame:
    """(query_id, context): the blocks of a query, bounded by the budget, in order."""
    parts = F.sort_array(F.collect_list(F.struct("position", "block")))
    return packed.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["block"]), SEPARATOR).alias("context"))


def citations(answers: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, position, citation): the first sentence of each retrieved document that the answer holds.

    Sentences are compared in lower case with single spaces and returned as they stand.
    """
    told = answers.select("query_id", F.lower(collapse("answer")).alias("told"))
    each = found.select("query_id", "position", F.posexplode(sentences("text")).alias("nth", "citation")).join(told, "query_id")
    held = each.filter(F.contains("told", F.lower(collapse("citation"))))
    return held.groupBy("query_id", "position").agg(F.min(F.struct("nth", "citation"))["citation"].alias("citation"))


def citation_footer(cited: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(query_id, footer): the first few citations as numbered lines with their share in percent."""
    s = settings or Settings()
    line = F.format_string("%d. %s (%.2f%%)", F.col("n"), F.col("label"), F.col("score") * 100)
    by = Window.partitionBy("query_id").orderBy("position")
    rows = cited.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= s.max_citations).withColumn("line", line)
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda p: p["line"]), "\n").alias("footer"))


def source_cards(found: DataFrame, preview: int = 200) -> DataFrame:
    """Preview, rounded relevance and filled-in defaults of every retrieved document."""
    short = F.when(F.length("text") > preview, F.concat(F.substring("text", 1, preview), F.lit("..."))).otherwise(F.col("text"))
    return found.select("query_id", "position", F.coalesce(first_filled("title"), F.lit("N/A")).alias("title"), F.coalesce(first_filled("source"), F.lit("N/A")).alias("source"), short.alias("preview"), F.round("score", 2).alias("relevance"))
