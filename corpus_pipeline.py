"""The corpus pipeline: documents through five stages, each stage's result written as Parquet and read again.

Quality classifier, line dedup, near-dedup, benchmark decontamination, packing.  Every stage works on all that the one before
kept, and all but the last return the columns of documents.

Defined results, stage by stage: an empty table of documents gives an empty result of every stage; a null text is scored as an empty
one, has no lines, is linked with nothing, holds no item and packs as its end id; rows without doc_id are scored, but neither
compared nor dropped by a later stage; repeated rows are one document to line dedup and near-dedup, which keeps all rows of the
doc_id that stays; further columns of documents, whatever their names, come through all stages but the last as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import decontam, line_dedup, near_dedup, packing, quality
from quarrystone.llm.queries import WORD_TOKENIZER, table, tokenizer_file
from quarrystone.llm.shared import materialize, small_batches


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows, predicts good."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines of recurring templates; n_chars follows the text."""
    return line_dedup.strip_lines(docs, length_col="n_chars")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return near_dedup.drop_near_duplicates(docs, size=5, percent=80)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of 4096 tokens."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_file(WORD_TOKENIZER))


STAGES = [("quality", good_quality), ("line_dedup", own_lines), ("near_dedup", one_of_each), ("decontamination", clean_of_benchmark), ("packing", packed)]

#: A trained model and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
