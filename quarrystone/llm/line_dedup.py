"""Line deduplication with a log-template tree.

Lines descend a tree of fixed depth: by token count, then by their leading tokens, with every token that holds a digit already
generalised to ``<*>``.  In a leaf, a token is constant at its position if at least ``min_docs`` lines have it there; any other
is a variable field and generalised too.  What results is the line's template.  A template recurs if at least
``min_docs`` documents hold it and at least half of its tokens are constant.  Recurring lines stay in the document with the
smallest doc_id that holds them, whole, and are dropped from all others.

All of it is joins and grouped sums over lines; only lines of leaves that can recur are shuffled with their words, and their forms
are never gathered by leaf: a leaf of one form needs no rule of its own, as all its tokens are frequent enough to be constant.

Defined results: a null text stays null and has no lines; empty lines and lines of white space are kept; a document whose
lines are all dropped has an empty text; repeated rows count as one document; rows without doc_id count for nothing and
lose nothing; an empty table gives no rows; extra columns are kept as they are, whatever their names, but for own columns called
n_lines or n_dropped where ``dedup_lines`` adds these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.shared import discard, materialize

DEPTH = 3
MIN_DOCS = 10
CONSTANT_SHARE = 0.5
VARIABLE = "<*>"
#: Up to so many leaves, line forms or templates are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000


def spaced(line: Column) -> Column:
    """The line with single spaces between its tokens and none at its ends."""
    odd = F.contains(line, F.lit("  "))
    for mark in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(mark))
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def generalised(tokens: Column) -> Column:
    """Tokens that hold digits as variable fields."""
    return F.when(tokens.rlike("[0-9]"), F.regexp_replace(tokens, r"[^ ]*[0-9][^ ]*", VARIABLE)).otherwise(tokens)


def line_form(line: Column) -> Column:
    return generalised(spaced(line))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def count_tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def document_lines(docs: DataFrame, depth: int) -> DataFrame:
    """(doc_id, line, leaf) of every line that has tokens; the leaf is a hash of token count and leading tokens."""
    lines = docs.filter("doc_id IS NOT NULL").select("doc_id", F.explode(lines_of(F.col("text"))).alias("line"))
    lines = lines.select("doc_id", spaced(F.col("line")).alias("line")).filter("line != ''")
    return lines.withColumn("leaf", F.xxhash64(count_tokens(F.col("line")), generalised(F.substring_index("line", " ", depth))))


def recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, share: float = CONSTANT_SHARE) -> DataFrame:
    """(doc_id, form) of the lines to drop."""
    lines = document_lines(docs.select("doc_id", "text"), depth)
    leaves = materialize(lines.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("leaf"), "leaves")
    small = F.broadcast(leaves) if leaves.count() <= BROADCAST_ROWS else leaves
    open_lines = lines.join(small, "leaf", "left_semi").select("doc_id", "leaf", generalised(F.col("line")).alias("form"))
    open_lines = materialize(open_lines.withColumn("form_key", F.xxhash64("form")), "open-lines")
    discard(leaves)
    forms = materialize(open_lines.groupBy("leaf", "form_key", "form").agg(F.count("*").alias("n")), "forms")

    # Each position's frequent tokens are constant.
    tokens = forms.select("leaf", "form_key", "n", F.posexplode(F.split("form", " ")).alias("pos", "token"))
    constant = tokens.filter(F.col("pos") >= depth).groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)
    constant = materialize(constant.select("leaf", "pos", "token", F.lit(True).alias("constant")), "constants")
    told = tokens.join(F.broadcast(constant) if constant.count() <= BROADCAST_ROWS else constant, ["leaf", "pos", "token"], "left")
    fixed = ((F.col("pos") < depth) | F.coalesce("constant", F.lit(False))) & (F.col("token") != VARIABLE)
    told = told.withColumn("shown", F.when(fixed, F.col("token")).otherwise(VARIABLE))
    templates = told.groupBy("form_key").agg(F.sort_array(F.collect_list(F.struct("pos", "shown"))).alias("parts"))  # as long as the line
    templates = templates.select("form_key", F.transform("parts", lambda p: p["shown"]).alias("template"))
    templates = templates.withColumn("fixed", F.size(F.filter("template", lambda t: t != VARIABLE))).filter(F.col("fixed") >= share * F.size("template"))
    # Token counts differ between leaves and are part of the template; so are the leading tokens.
    templates = materialize(templates.select("form_key", F.xxhash64("template").alias("template")), "templates")

    known = F.broadcast(templates) if templates.count() <= BROADCAST_ROWS else templates
    marked = open_lines.select("doc_id", "form_key").join(known, "form_key").distinct()
    marked = materialize(marked, "marked-lines")
    recurring = marked.select("doc_id", "template").distinct().groupBy("template").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first")).filter(F.col("n_docs") >= min_docs)
    # Stored, so that the join can split a very common template.
    recurring = materialize(recurring.select("template", "first"), "recurring")
    recurring = F.broadcast(recurring) if recurring.count() <= BROADCAST_ROWS else recurring
    drops = marked.join(recurring, "template").filter("doc_id != first").select("doc_id", "form_key")
    discard(open_lines, forms)
    return drops


def _left(docs: DataFrame, depth: int, min_docs: int, share: float) -> DataFrame:
    """Columns own_0, own_1, ... of ``docs``, and left_text, n_lines and n_dropped: no name of ``docs`` can clash with an inner one."""
    drops = recurring_lines(docs, depth, min_docs, share)
    drops = drops.groupBy("doc_id").agg(F.collect_set("form_key").alias("drop_keys")).withColumnRenamed("doc_id", "drop_doc")  # no more than the document's lines
    own = docs.toDF(*[f"own_{i}" for i in range(len(docs.columns))])
    ident, text = (F.col(f"own_{docs.columns.index(c)}") for c in ("doc_id", "text"))
    both = own.join(drops, ident == F.col("drop_doc"), "left")
    lines = lines_of(text)
    left = F.filter(lines, lambda line: ~F.array_contains(F.col("drop_keys"), F.xxhash64(line_form(line))))
    both = both.withColumn("kept_lines", F.when(F.col("drop_keys").isNotNull() & text.isNotNull(), left))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    return both.select(
        *own.columns,
        F.when(F.col("kept_lines").isNotNull(), F.array_join("kept_lines", "\n")).otherwise(text).alias("left_text"),
        n_lines.alias("n_lines"),
        F.when(F.col("kept_lines").isNotNull(), n_lines - F.size("kept_lines")).otherwise(0).cast("bigint").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, share: float = CONSTANT_SHARE) -> DataFrame:
    """All columns of ``docs`` with the text that is left, plus n_lines and n_dropped."""
    own = [F.col("left_text" if c == "text" else f"own_{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_dropped")]
    return _left(docs, depth, min_docs, share).select(*own, "n_lines", "n_dropped")


def strip_lines(docs: DataFrame, length_col: str = "n_chars", depth: int = DEPTH, min_docs: int = MIN_DOCS, share: float = CONSTANT_SHARE) -> DataFrame:
    """The columns of ``docs`` and no more, with the text that is left; ``length_col`` follows where lines were dropped."""
    length = lambda c: F.when(F.col("n_dropped") > 0, F.length("left_text")).otherwise(c).cast(docs.schema[length_col].dataType)
    own = [F.col("left_text") if c == "text" else length(F.col(f"own_{i}")) if c == length_col else F.col(f"own_{i}") for i, c in enumerate(docs.columns)]
    return _left(docs, depth, min_docs, share).select(*[x.alias(c) for x, c in zip(own, docs.columns, strict=True)])
