"""Chat formatting with typed content parts.

A message is a list of typed parts (text, image, audio, document).  A visitor turns each part, in order, into text of the
template: a text part into its escaped text, any other into a placeholder of its own control token, with an attachment record
(message position, part position, type, reference, tokens) and the number of tokens that the placeholder expands to.  Turns are
marked ``<|im_start|>role`` newline text ``<|im_end|>`` newline.

Control strings all begin with ``<|``.  Inside texts and roles each ``<`` gets a backslash behind it, whatever follows, so no control
string can arise there, nor where two parts meet; taking these backslashes away again restores any text exactly.  What is
read back comes from the marks alone: a control string that got through would show as a turn of its own.

Each turn becomes one row, so a conversation of any length is never gathered; readers order the rows by (conv_id, turn).

Defined results: null or missing parts, texts and roles are empty; a part of unknown type raises no error and becomes a
document placeholder without tokens; rows with equal (conv_id, turn) are ordered by role, then text; a null turn comes first; a
null conv_id is a conversation of its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "\n"
#: A line feed inside a role, which would else end the head of its turn.
ROLE_NEWLINE = "<|nl|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that an attachment expands to: pixels a side of an image token, audio tokens a second, tokens a document page.
IMAGE_PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 12.5, 512


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<\\"), F.lit("<"))


class PartVisitor:
    """Columns for one content part.  Subclass and override a ``visit_`` method to change a type's form or its cost."""

    def visit_text(self, part: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(0)

    def visit_image(self, part: Column) -> tuple[Column, Column]:
        side = lambda x: F.ceil(F.coalesce(part[x], F.lit(0)) / IMAGE_PATCH).cast("int")
        return F.lit("<|image|>"), side("width") * side("height")

    def visit_audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE).cast("int")

    def visit_document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS

    def visit(self, part: Column, take: Callable[[tuple[Column, Column]], Column]) -> Column:
        kind = F.coalesce(part["type"], F.lit("text"))
        out = F.when(kind == "text", take(self.visit_text(part)))
        out = out.when(kind == "image", take(self.visit_image(part))).when(kind == "audio", take(self.visit_audio(part)))
        return out.otherwise(take(self.visit_document(part)))


def text_messages(rows: DataFrame) -> DataFrame:
    """Plain (conv_id, turn, role, text) rows as messages of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.col("text"), *[F.lit(None).cast(k).alias(n) for n, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])
    return rows.select("conv_id", "turn", "role", F.array(part).alias("content"))


def format_messages(messages: DataFrame, visitor: PartVisitor | None = None, learn_role: str = "assistant") -> DataFrame:
    """One formatted segment a message.

    (conv_id, turn, role, formatted, loss_start, loss_chars, attachments, expanded_tokens); the loss mask of a segment is
    [loss_start, loss_start + loss_chars) in code points, and empty but for turns of ``learn_role``.
    """
    visitor = visitor or PartVisitor()
    parts = F.coalesce("content", F.array().cast(f"array<{PART}>"))
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit(NEWLINE), F.lit(ROLE_NEWLINE))
    flat = messages.select(
        "conv_id",
        "turn",
        "role",
        F.concat(F.lit(START), role, F.lit(NEWLINE)).alias("head"),
        F.array_join(F.transform(parts, lambda p: visitor.visit(p, lambda v: v[0])), "").alias("body"),
        F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), visitor.visit(p, lambda v: v[1]).alias("tokens"))).alias("seen"),
    )
    learned = F.when(F.col("role") == learn_role, F.length("body")).otherwise(0)
    return flat.select(
        "conv_id",
        "turn",
        "role",
        F.concat("head", "body", F.lit(END + NEWLINE)).alias("formatted"),
        F.length("head").alias("loss_start"),
        learned.alias("loss_chars"),
        F.filter("seen", lambda a: F.coalesce(a["type"], F.lit("text")) != "text").alias("attachments"),
        F.aggregate("seen", F.lit(0), lambda n, a: n + F.coalesce(a["tokens"], F.lit(0))).alias("expanded_tokens"),
    )


def parse_segments(formatted: DataFrame) -> DataFrame:
    """Read turns and learned text back from formatted segments by their marks, without the columns they were made from.

    Every start mark begins a turn (``mark`` numbers them in a segment), whose role ends at the line feed and whose text at the
    next end mark.  The learned text is what the mask covers; it goes with the segment's first turn.
    """
    marked = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_chars", F.posexplode(F.split("formatted", re.escape(START))).alias("mark", "piece"))
    marked = marked.filter("mark > 0")  # nothing comes before the first
    cut = F.instr("piece", NEWLINE)
    first = F.col("mark") == 1
    learned = F.when(first, F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_chars"))).otherwise("")
    return marked.select(
        "conv_id",
        "turn",
        "mark",
        unescape(F.replace(F.substring(F.col("piece"), F.lit(1), cut - 1), F.lit(ROLE_NEWLINE), F.lit(NEWLINE))).alias("read_role"),
        unescape(F.substring_index(F.substring(F.col("piece"), cut + 1, F.length("piece")), END, 1)).alias("read_text"),
        unescape(learned).alias("learned"),
        F.when(first, F.length("formatted")).otherwise(0).cast("bigint").alias("n_formatted"),
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation as read back; tasks stream over sorted turns and keep running hashes only."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for batch in batches:
            done: list[list] = []
            for conv, _, _, role, text, learned, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = [conv, 0, sha256(), 0, sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now[3] += len(learned)
                now[4].update(learned.encode("utf-8", "surrogatepass"))
                now[5] += n
            yield rows(done)
        if now is not None:
            yield rows([now])

    def rows(done: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{name: v.hexdigest() if hasattr(v, "hexdigest") else v for name, v in zip(kinds.names, row, strict=True)} for row in done], schema=kinds)

    turns = parse_segments(formatted)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "mark", "read_role", "read_text")
    return ordered.mapInArrow(digest, schema)
