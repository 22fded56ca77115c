"""Token counts from an exact length histogram.

Each document is encoded once and counts as one row of a histogram by encoded length, summed before anything is shuffled.
Suffix sums over the histogram then answer totals, quantiles and truncated totals for every context limit; they are taken in
two levels (within ranges of lengths, then over the ranges), so no task reads the whole histogram.

Defined results: null and empty texts have length 0 and are counted; repeated rows count once each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.shared import id_and_text, materialize

RANGE = 256
_ENCODERS: dict[str, object] = {}


def encoder(rank_file: str, pattern: str):
    """The byte-level encoder of a rank file, made once in each worker process."""
    if rank_file not in _ENCODERS:
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[rank_file] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[rank_file]


def token_lengths(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens) of every whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(rank_file, pattern).encode_ordinary
        for batch in batches:
            lengths = [len(encode(text)) if text else 0 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["doc_id", "n_tokens"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return id_and_text(docs).mapInArrow(count, f"doc_id {ids}, n_tokens bigint")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each encoded length that occurs, with suffix sums.

    n_docs documents have exactly n_tokens; docs_at_least and tokens_at_least are over all documents of that length or more;
    truncated_total is what is left of all tokens at the limit n_tokens, lost_tokens what is cut there, and quantile the share
    of documents that fit into it.
    """
    counts = materialize(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")  # read twice: encode once
    counts = counts.withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    ranges = counts.groupBy("range").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    over = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("docs").over(over), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("tokens_over"),
        F.sum("docs").over(everything).alias("total_docs"),
        F.sum("tokens").over(everything).alias("total_tokens"),
    )
    here = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.join(ranges, "range").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(here) + F.col("docs_over")).alias("docs_at_least"),
        (F.sum(F.col("n_docs") * F.col("n_tokens")).over(here) + F.col("tokens_over")).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    lost = F.col("tokens_at_least") - F.col("n_tokens") * F.col("docs_at_least")
    fit = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    return sums.withColumns({"truncated_total": F.col("total_tokens") - lost, "lost_tokens": lost, "quantile": fit / F.col("total_docs")})


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for given context limits, read from the suffix sums at the next longer length: documents cut, tokens left and tokens lost at each."""
    sums = F.struct("n_tokens", "docs_at_least", "tokens_at_least")
    asked = F.explode(F.array(*[F.lit(x).cast("bigint") for x in limits])).alias("limit")
    longer = F.min(F.when(F.col("n_tokens") > F.col("limit"), F.col("sums"))).alias("over")
    found = histogram.select("total_docs", "total_tokens", sums.alias("sums"), "n_tokens", asked).groupBy("limit").agg(F.max("total_docs").alias("total_docs"), F.max("total_tokens").alias("total_tokens"), longer)
    cut, tokens = F.coalesce("over.docs_at_least", F.lit(0)), F.coalesce("over.tokens_at_least", F.lit(0))
    lost = tokens - F.col("limit") * cut
    return found.select("limit", "total_docs", cut.alias("docs_cut"), (F.col("total_tokens") - lost).alias("truncated_total"), lost.alias("lost_tokens"))
