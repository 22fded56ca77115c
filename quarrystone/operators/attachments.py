"""Texts that come with a question: excerpts for the prompt and for the search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import collapse

#: Most characters of one attachment and of all, in a prompt; of a search text, and of each attachment's part in it.
EACH, ALL, SEARCH, SEARCH_EACH = 4000, 8000, 2000, 500


def excerpts(attachments: DataFrame, each: int = EACH, most: int = ALL) -> DataFrame:
    """(query_id, excerpt) from (query_id, nth, filename, text): the attachments that have a text, in order, each under its name and
    clipped, as far as they fit.  A question's attachments are a short list."""
    told = attachments.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    block = F.concat(F.lit("["), F.coalesce("filename", F.lit("attachment")), F.lit("]\n"), F.substring("text", 1, each))
    lists = told.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("nth", block.alias("block")))).alias("list"))
    return lists.select("query_id", F.substring(F.array_join(F.transform("list", lambda x: x["block"]), "\n\n"), 1, most).alias("excerpt"))


def search_texts(queries: DataFrame, attachments: DataFrame, most: int = SEARCH, each: int = SEARCH_EACH) -> DataFrame:
    """(query_id, text): what is searched for: the question and the beginning of each attachment, on one line and clipped."""
    parts = attachments.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("query_id", "nth", F.substring(collapse("text"), 1, each).alias("part"))
    lists = parts.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("nth", "part"))).alias("list"))
    more = F.coalesce(F.array_join(F.transform("list", lambda x: x["part"]), " "), F.lit(""))
    return queries.join(lists, "query_id", "left").select("query_id", F.substring(F.trim(F.concat_ws(" ", F.trim(F.coalesce("text", F.lit(""))), more)), 1, most).alias("text"))
