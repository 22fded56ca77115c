"""What is let in: query routing, option clamps, uploads, access, spaces, cache entries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import collapse, url_space


@dataclass(frozen=True)
class Lexicon:
    """Words of the router; a deployment brings its own."""

    domain_hints: Sequence[str] = ()
    phrases: Sequence[str] = ()
    greetings: Sequence[str] = ()
    off_topic: Sequence[str] = ()


def alternatives(words: Sequence[str]) -> str:
    return "|".join(words) if words else r"[^\s\S]"


def route(query: Column, lexicon: Lexicon) -> Column:
    """``chitchat``, ``off_topic`` or ``retrieve``.  A domain hint always retrieves; chit-chat is tested first."""
    q = F.lower(collapse(F.coalesce(query, F.lit(""))))
    words = F.when(q == "", 0).otherwise(F.size(F.split(q, " ")))
    hinted = q.rlike(f"({alternatives(lexicon.domain_hints)})")
    phrase = q.rlike(f"^({alternatives(lexicon.phrases)})[.!? ]*$")
    greeting = q.rlike(f"^({alternatives(lexicon.greetings)})([ ,.!?]|$)") & (words <= 3)
    chitchat = (F.length(q) <= 60) & (words <= 5) & (phrase | greeting)
    off_topic = (F.length(q) <= 120) & (words <= 14) & q.rlike(f"({alternatives(lexicon.off_topic)})")
    return F.when(hinted, "retrieve").when(chitchat, "chitchat").when(off_topic, "off_topic").otherwise("retrieve")


def admitted(query: Column, has_attachments: Column) -> Column:
    """Why a query is rejected; null if it isn't."""
    q = F.trim(F.coalesce(query, F.lit("")))
    return F.when(F.length(q) > 1000, "too_long").when((q == "") & ~has_attachments, "empty").when((F.length(q) < 3) & ~has_attachments, "too_short")


def clamped_int(value: Column, default: int, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("int"), F.lit(default))))


def clamped_double(value: Column, default: float, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("double"), F.lit(default))))


def whitelisted(value: Column, allowed: Sequence[str], default: str) -> Column:
    return F.when(F.lower(F.trim(value)).isin(*allowed), F.lower(F.trim(value))).otherwise(default)


def spaces_kept(url: Column, include: Sequence[str], exclude: Sequence[str], system: Sequence[str]) -> Column:
    """Whether a crawler takes a page of this space; an include list wins over nothing but itself."""
    space = url_space(url)
    ok = ~space.isin(*exclude, *system) if exclude or system else F.lit(True)
    return ok & space.isin(*include) if include else ok


def attachment_kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("png", "jpg", "jpeg", "gif", "webp"), "image").when(ext.isin("txt", "md", "csv", "json", "log", "html", "xml"), "text").otherwise("rejected")


def accessible(sessions: DataFrame, user_id: int | None, guest_ids: DataFrame) -> DataFrame:
    """Sessions of the user, and guest sessions whose id the caller holds."""
    guests = sessions.filter("user_id IS NULL").join(guest_ids, "session_id", "left_semi")
    return guests if user_id is None else sessions.filter(F.col("user_id") == user_id).unionByName(guests)


def ordered_distinct(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Each value of a group once, at its first place."""
    first = rows.groupBy(group, value).agg(F.min(order).alias(order))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(order)))


def cache_survivors(entries: DataFrame, now: Column, ttl_seconds: int, capacity: int) -> DataFrame:
    """Entries that are neither expired nor, beyond the capacity, least recently used."""
    fresh = entries.filter(F.col("created_at") + F.make_interval(secs=F.lit(ttl_seconds)) > now)
    return fresh.orderBy(F.desc("last_accessed"), "key").limit(capacity)


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct keys that still have to be computed."""
    return wanted.select("key").distinct().join(cache.select("key"), "key", "left_anti")


def valid_text(text: Column, least: int = 3, most: int = 1000) -> Column:
    """Whether a text has a length within bounds and no control characters but tabs and line breaks; null for null."""
    return F.length(text).between(least, most) & ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")


def latest(rows: DataFrame, key: str, at: str, tie: str, since: Column, most: int) -> DataFrame:
    """The last ``most`` rows of each key after ``since``; each task hands on as many of a key at most, however common it is."""
    by = Window.partitionBy(key).orderBy(F.desc(at), tie)
    return rows.filter(F.col(at) > since).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most)
