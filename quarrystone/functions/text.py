"""Scalar text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"
ARROW = " → "


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-case word runs, in order, with repeats; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def strip(text: Column | str) -> Column:
    """Without white space at both ends, in the Unicode sense."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def collapse(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(col(text), r"(?U)\s+", " "))


def clip(text: Column | str, limit: int) -> Column:
    """Collapsed text of at most ``limit`` characters, with three dots where it was cut."""
    c = collapse(F.coalesce(col(text), F.lit("")))
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 3)), F.lit("..."))).otherwise(c)


def clip_hard(text: Column | str, limit: int) -> Column:
    return F.substring(F.coalesce(col(text), F.lit("")), 1, limit)


def first_filled(*columns: Column | str) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in columns])


def join_path(parts: Column) -> Column:
    """Non-blank parts joined by an arrow."""
    return F.array_join(F.filter(parts, lambda p: F.trim(F.coalesce(p, F.lit(""))) != ""), ARROW)


def chunk_id(path: Column | str, index: Column | str) -> Column:
    return F.md5(F.concat_ws("_", col(path), col(index).cast("string")))


def sigmoid(x: Column | str) -> Column:
    """The logistic function; far arguments give 0 or 1 without overflow."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(col(x), F.lit(700.0)), F.lit(-700.0))))


def relevance(distance: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - col(distance)))


def topic_key(question: Column | str, stop_words: Sequence[str], words: int = 5, letters: int = 4) -> Column:
    """The first words of at least ``letters`` letters that are no stop words; the head of the text where there are none."""
    long_words = F.regexp_extract_all(F.lower(col(question)), F.lit(r"\p{L}{%d,}" % letters), F.lit(0))
    kept = F.filter(long_words, lambda w: ~w.isin(*stop_words)) if stop_words else long_words
    key = F.array_join(F.slice(kept, 1, words), " ")
    return F.when(key != "", key).otherwise(F.substring(F.lower(F.trim(col(question))), 1, 80))


def normal_path(path: Column | str) -> Column:
    """Forward slashes, none in front."""
    return F.regexp_replace(F.translate(col(path), "\\", "/"), "^/+", "")


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1))


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def folder(path: Column | str) -> Column:
    """The parent folder; empty at the top."""
    return F.regexp_replace(col(path), r"/?[^/]*$", "")


def normal_url(url: Column | str) -> Column:
    """Scheme and host in lower case, repeated slashes of the path as one, no query, fragment or slash at the end."""
    u = F.regexp_replace(F.trim(col(url)), r"[?#].*$", "")
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    path = F.substring(u, F.length(head) + 1, F.length(u))
    return F.concat(head, F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "/$", ""))


def view_url(url: Column | str, site: Column | str, prefix: str = "") -> Column:
    """The canonical form of an address of the same host as ``site`` whose path begins with ``prefix``; null for any other."""
    host = lambda c: F.lower(F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(normal_url(url), r"^[^/]*//[^/]*(/.*)?$", 1)
    return F.when((host(url) == host(site)) & F.startswith(path, F.lit(prefix)), normal_url(url))


def url_space(url: Column | str) -> Column:
    """The first folder of a URL's path; empty if there is none."""
    return F.regexp_extract(normal_url(url), r"^[^/]*//[^/]*/([^/]+)", 1)


def clean_component(name: Column | str, limit: int = 80) -> Column:
    """A file name part: forbidden characters as underscores, no dots or spaces at the ends, a hash where it is cut."""
    c = F.regexp_replace(F.regexp_replace(col(name), r'[<>:"/\\|?*\x00-\x1F]+', "_"), r"^[ .]+|[ .]+$", "")
    c = F.when(F.upper(c).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("_"), c)).when(c == "", "_").otherwise(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 9), F.lit("_"), F.substring(F.sha1(col(name)), 1, 8))).otherwise(c)


def chat_title(text: Column | str, limit: int = 60) -> Column:
    """A session's title from its first message."""
    c = collapse(F.coalesce(col(text), F.lit("")))
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def sentences(text: Column | str, shortest: int = 20) -> Column:
    """Trimmed sentences longer than ``shortest`` characters."""
    return F.filter(F.transform(F.split(col(text), r"[.!?]+"), strip), lambda s: F.length(s) > shortest)


def json_object(text: Column | str) -> Column:
    """The JSON object that a text is or, between its outermost braces, holds; empty where there is none that can be read."""
    whole, held = F.trim(col(text)), F.regexp_extract(col(text), r"(?s)(\{.*\})", 1)
    reads = lambda c: c.startswith("{") & F.get_json_object(c, "$").isNotNull()
    return F.when(reads(whole), whole).when(reads(held), held).otherwise("")


def sniffed_headings(html: Column | str, most: int = 5) -> Column:
    """The first headings of a page as they stand in its source, without a parser."""
    return F.array_join(F.slice(F.regexp_extract_all(col(html), F.lit("(?s)<h[1-6][^>]*>(.*?)</h"), F.lit(1)), 1, most), " | ")


def without_controls(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def highlight(text: Column | str, phrases: Column, before: str = "**", after: str = "**") -> Column:
    """Every occurrence of each phrase marked, one phrase after the other."""
    return F.aggregate(phrases, col(text), lambda t, p: F.replace(t, p, F.concat(F.lit(before), p, F.lit(after))))
