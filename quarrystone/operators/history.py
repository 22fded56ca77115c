"""Chat history: sessions, messages, feedback, weak answers and knowledge gaps.

Tables are sessions(session_id, user_id, title, created_at, updated_at), messages(message_id, session_id, role, content,
sources_json, metadata_json, created_at), feedback(feedback_id, message_id, session_id, rating, comment, created_at) and
users(user_id, ...).  Times are given; nothing reads a clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import clip, first_filled, topic_key

SOURCES = "array<struct<title:string,source:string,path:string,score:double>>"
METADATA = "struct<retrieve_error:string,retrieval_status:string,diagnostics:struct<retrieval_status:string>>"
#: Statuses under which an answer counts as weak.
BAD_STATUS = ("search_error", "embedding_unavailable", "no_hits")
#: Below this best score an answer is weak.  Default hybrid scores stay under 0.22, so it marks all of them, as it always has.
WEAK_SCORE = 0.35


def recent_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each session, numbered in time order."""
    late = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("message_id"))
    kept = messages.withColumn("back", F.row_number().over(late)).filter(F.col("back") <= n)
    early = Window.partitionBy("session_id").orderBy(F.desc("back"))
    return kept.withColumn("position", F.row_number().over(early)).drop("back")


def history_blocks(messages: DataFrame, n: int, limit: int = 700) -> DataFrame:
    """(session_id, history): the last messages as labelled, clipped lines."""
    label = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant").otherwise("System")
    lines = recent_messages(messages, n).withColumn("line", F.concat(label, F.lit(": "), clip("content", limit)))
    return lines.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda p: p["line"]), "\n").alias("history"))


def session_page(sessions: DataFrame, limit: int, offset: int) -> DataFrame:
    """One page of sessions, newest first; limits outside 1..100 and negative offsets are clamped."""
    return sessions.orderBy(F.desc("updated_at"), "session_id").offset(max(0, offset)).limit(max(1, min(100, limit)))


def like_pattern(term: str) -> str:
    return f"%{term}%"


def search_sessions(sessions: DataFrame, messages: DataFrame, term: str, unicode_case: bool = False) -> DataFrame:
    """Sessions whose title or any message is like the term.

    ``%`` and ``_`` in the term are wildcards.  ASCII letters match in either case; ``unicode_case`` extends that to all.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fold = F.lower if unicode_case else lambda c: F.translate(c, upper, lower)
    pattern = like_pattern(term.lower() if unicode_case else term.translate(str.maketrans(upper, lower)))
    told = messages.filter(fold(F.col("content")).like(pattern)).select("session_id").distinct()
    hit = sessions.join(told.withColumn("told", F.lit(True)), "session_id", "left")
    return hit.filter(F.col("told") | fold(F.coalesce("title", F.lit(""))).like(pattern)).drop("told")


def retention_candidates(sessions: DataFrame, users: DataFrame, cutoff: Column, limit: int) -> DataFrame:
    """Sessions without a living user, last used before the cutoff; the oldest first."""
    orphans = sessions.join(users.select("user_id"), "user_id", "left_anti").filter(F.col("updated_at") < cutoff)
    return orphans.orderBy("updated_at", "session_id").limit(max(1, min(10_000, limit)))


def delete_sessions(sessions: DataFrame, messages: DataFrame, feedback: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left after a cascading delete; feedback on deleted messages of other sessions loses its message."""
    ids = gone.select("session_id").distinct()
    left = messages.join(ids, "session_id", "left_anti")
    votes = feedback.join(ids, "session_id", "left_anti")
    alive = left.select("message_id").withColumn("alive", F.lit(True))
    votes = votes.join(alive, "message_id", "left").withColumn("message_id", F.when(F.col("alive"), F.col("message_id"))).drop("alive")
    return sessions.join(ids, "session_id", "left_anti"), left, votes


def feedback_summary(feedback: DataFrame, since: Column | None = None) -> DataFrame:
    """One row: up, down and total votes; the total has other ratings too."""
    votes = feedback if since is None else feedback.filter(F.col("created_at") >= since)
    return votes.agg(F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"), F.count("*").alias("total"))


def feedback_context(feedback: DataFrame, messages: DataFrame, sessions: DataFrame, limit: int) -> DataFrame:
    """The newest votes with their message and session, where these still exist."""
    m = messages.select("message_id", F.col("content").alias("message"))
    s = sessions.select("session_id", F.col("title").alias("session_title"))
    return feedback.join(m, "message_id", "left").join(s, "session_id", "left").orderBy(F.desc("created_at"), F.desc("feedback_id")).limit(limit)


def exploded_sources(messages: DataFrame) -> DataFrame:
    """One row a source of each message, newest message first; a malformed list has none."""
    rows = messages.withColumn("sources", F.from_json("sources_json", SOURCES))
    rows = rows.select("message_id", "created_at", F.posexplode("sources").alias("nth", "s"))
    key = F.coalesce(first_filled("s.path", "s.title", "s.source"), F.lit("N/A"))
    return rows.select("message_id", "created_at", "nth", key.alias("source_key"), F.col("s.title").alias("title"), F.col("s.path").alias("path"))


def top_sources(messages: DataFrame, limit: int, scan_limit: int = 10_000) -> DataFrame:
    """The most used sources over the newest assistant messages; titles as first seen in that order."""
    told = messages.filter((F.col("role") == "assistant") & F.col("sources_json").isNotNull())
    newest = told.orderBy(F.desc("created_at"), F.desc("message_id")).limit(max(1, min(10_000, scan_limit)))
    return _count_sources(exploded_sources(newest), limit)


def negative_sources(feedback: DataFrame, messages: DataFrame, limit: int) -> DataFrame:
    """The same over messages that were voted down; a message counts once a vote."""
    down = feedback.filter(F.col("rating") == "down").select("message_id")
    return _count_sources(exploded_sources(down.join(messages.filter(F.col("sources_json").isNotNull()), "message_id")), limit)


def _count_sources(sources: DataFrame, limit: int) -> DataFrame:
    order = F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), (-F.col("message_id")).alias("m"), "nth")
    counted = sources.groupBy("source_key").agg(F.count("*").alias("uses"), F.min_by("title", order).alias("title"))
    return counted.orderBy(F.desc("uses"), "source_key").limit(limit)


def weak_reason(sources_json: str = "sources_json", metadata_json: str = "metadata_json") -> Column:
    """Why an answer is weak; null if it isn't.  The first of: an error, a bad status, no sources, a low best score."""
    sources, meta = F.from_json(F.col(sources_json), SOURCES), F.from_json(F.coalesce(F.col(metadata_json), F.lit("{}")), METADATA)
    status = F.coalesce(meta["diagnostics"]["retrieval_status"], meta["retrieve_error"], meta["retrieval_status"])
    best = F.coalesce(F.array_max(F.transform(sources, lambda s: s["score"])), F.lit(0.0))
    return (
        F.when(F.trim(F.coalesce(meta["retrieve_error"], F.lit(""))) != "", "retrieve_error")
        .when(status.isin(*BAD_STATUS), "bad_status")
        .when(F.coalesce(F.size(sources), F.lit(0)) <= 0, "no_sources")
        .when(best < WEAK_SCORE, "low_score")
    )


def weak_answers(messages: DataFrame, limit: int, scan_limit: int = 10_000) -> DataFrame:
    """Weak answers, newest first, with the last question before each in its session (inside the scanned rows)."""
    scanned = messages.filter(F.col("role").isin("user", "assistant")).orderBy(F.desc("created_at"), F.desc("message_id")).limit(scan_limit)
    return all_weak_answers(scanned).orderBy(F.desc("created_at"), F.desc("message_id")).limit(limit)


def all_weak_answers(messages: DataFrame) -> DataFrame:
    """Weak answers of the whole table, with the last question before each in its session."""
    before = Window.partitionBy("session_id").orderBy("created_at", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    asked = messages.withColumn("question", F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(before))
    weak = asked.filter(F.col("role") == "assistant").withColumn("reason", weak_reason()).filter(F.col("reason").isNotNull())
    return weak.select("message_id", "session_id", "question", "reason", "created_at")


def knowledge_gaps(messages: DataFrame, limit: int, stop_words: Sequence[str], scan_limit: int = 10_000) -> DataFrame:
    """Weak answers by topic: how many, their commonest reason (the first met wins ties), and the oldest question.

    The times are those of the oldest answer, as rows are read from the newest on and overwrite one another.
    """
    weak = weak_answers(messages, max(200, 20 * limit), scan_limit).filter(F.trim(F.coalesce("question", F.lit(""))) != "")
    weak = weak.withColumn("topic", topic_key("question", stop_words))
    recent = F.struct(F.col("created_at"), F.col("message_id"))
    by_reason = weak.groupBy("topic", "reason").agg(F.count("*").alias("n"), F.max(recent).alias("newest"), F.min(F.struct("created_at", "message_id", "question")).alias("oldest"))
    gaps = by_reason.groupBy("topic").agg(F.sum("n").alias("answers"), F.max(F.struct("n", "newest", "reason"))["reason"].alias("reason"), F.min("oldest").alias("oldest"))
    gaps = gaps.select("topic", "answers", "reason", F.col("oldest.question").alias("last_question"), F.col("oldest.created_at").alias("last_seen_at"))
    return gaps.orderBy(F.desc("answers"), F.desc("last_seen_at"), "topic").limit(limit)


def markdown_export(messages: DataFrame) -> DataFrame:
    """(session_id, markdown): a session's turns in order, one heading each."""
    name = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "Assistant").otherwise("System")
    parts = messages.withColumn("part", F.concat(F.lit("## "), name, F.lit("\n\n"), F.col("content")))
    return parts.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "message_id", "part"))), lambda p: p["part"]), "\n\n").alias("markdown"))
