"""Crawled pages as a source: texts, structural chunks, links and the order in which a crawler reaches them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.config import Settings
from quarrystone.functions.html import page_links, page_text, parse
from quarrystone.functions.text import normal_url, view_url
from quarrystone.operators.chunking import structural_chunks
from quarrystone.session import prepare, checkpoint_dir


def extract_pages(pages: DataFrame, mode: str = "mark") -> DataFrame:
    """(page_id, title, text, error) of every page; a page that can't be read has an error and no text, and stops nothing."""
    prepare(pages.sparkSession, 256)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows.append((page_id, *page_text(html, f"page {page_id}", mode), None))
                except (AssertionError, ValueError) as error:
                    rows.append((page_id, None, None, str(error) or type(error).__name__))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["page_id", "title", "text", "error"])

    return pages.select("page_id", "html").mapInArrow(read, "page_id bigint, title string, text string, error string")


def page_chunks(pages: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Structural chunks of every page."""
    prepare(pages.sparkSession, 256)
    found = structural_chunks(pages.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.col("html").alias("text")), True, settings)
    return found.withColumnRenamed("doc_id", "page_id").withColumn("parent_headings", F.to_json("parent_headings"))


def readable_links(html: str | None) -> list[str]:
    """Links of a page; none of one that the parser refuses (``extract_pages`` tells its error)."""
    try:
        return page_links(html)
    except (AssertionError, ValueError):
        return []


def links(pages: DataFrame, same_host: bool = False, prefix: str = "") -> DataFrame:
    """(page_id, nth, target): distinct absolute link targets of each page, in the order they appear.

    ``same_host`` keeps those that stay on the page's host, with a path that begins with ``prefix``.
    """
    prepare(pages.sparkSession, 256)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [readable_links(html) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["page_id", "url", "hrefs"])

    rows = pages.select("page_id", "url", "html").mapInArrow(read, "page_id bigint, url string, hrefs array<string>")
    rows = rows.select("page_id", "url", F.posexplode("hrefs").alias("nth", "href"))
    host = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1)
    target = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(host, F.col("href"))).otherwise(F.concat(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "[^/]*$", ""), F.col("href")))
    rows = rows.withColumn("target", normal_url(target)).filter(~F.col("href").startswith("#"))
    if same_host:
        rows = rows.withColumn("target", view_url("target", "url", prefix)).filter("target IS NOT NULL")
    return rows.groupBy("page_id", "target").agg(F.min("nth").cast("bigint").alias("nth"))


def preview(pages: DataFrame, shown: int = 3, known: DataFrame | None = None, largest: int = 50 * 1024 * 1024) -> DataFrame:
    """(page_id, n_chars, n_chunks, first, warning): what an index run would make of each page.

    Warnings, joined by commas: ``large`` above ``largest`` bytes, ``short`` below 200 characters, and ``duplicate`` if the page's address is
    one of ``known`` (url).
    """
    text = extract_pages(pages).select("page_id", F.length("text").cast("bigint").alias("n_chars"))
    chunks = page_chunks(pages).groupBy("page_id").agg(F.count("*").alias("n_chunks"), F.sort_array(F.collect_list(F.when(F.col("chunk_index") < shown, F.struct("chunk_index", F.substring("text", 1, 200).alias("head"))))).alias("heads"))
    both = text.join(chunks, "page_id", "left")
    raw = pages.select("page_id", (F.octet_length("html") > largest).alias("large"), normal_url("url").alias("url"))
    twice = known.select(normal_url("url").alias("url"), F.lit(True).alias("twice")).distinct() if known is not None else None
    raw = raw.join(twice, "url", "left") if twice is not None else raw.withColumn("twice", F.lit(False))
    both = both.join(raw.drop("url"), "page_id")
    told = F.array_compact(F.array(F.when(F.col("large"), "large"), F.when(F.coalesce("n_chars", F.lit(0)) < 200, "short"), F.when(F.col("twice"), "duplicate")))
    warning = F.when(F.size(told) > 0, F.array_join(told, ","))
    return both.select("page_id", "n_chars", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.array_join(F.transform("heads", lambda h: h["head"]), "\n").alias("first"), warning.alias("warning"))


#: Chains of pages that each link to the next one only are jumped over from this length on.
LONG_CHAIN = 32


def crawl_order(pages: DataFrame, max_pages: int | None = None, max_depth: int | None = None) -> DataFrame:
    """(url, depth) of the fetched pages in breadth-first order: host starts at depth 0, then what links reach.

    Each step is a join of the frontier with the link table and an anti join with what was seen; steps are checkpointed.
    They go on until nothing new is reached.  Where there are long chains, as in paged archives, links over 2, 4, 8 ... of their pages are
    added first, so that the steps grow with the logarithm of a chain's length.  Only bounds that a caller gives cut the result:
    depths below ``max_depth``, and the first ``max_pages`` rows.
    """
    checkpoint_dir(pages.sparkSession)  # where the steps are checkpointed
    fetched = pages.groupBy(normal_url("url").alias("url")).agg(F.min("page_id").alias("page_id")).checkpoint()  # of pages fetched twice the first
    edges = links(pages).join(fetched.select("page_id", "url"), "page_id").select(F.col("url").alias("origin"), "target")
    edges = edges.filter("origin != target").join(fetched.select(F.col("url").alias("target")), "target", "left_semi").distinct().checkpoint()
    starts = fetched.groupBy(F.regexp_extract("url", r"^([^/]*//[^/]*)", 1).alias("host")).agg(F.min("url").alias("url"))
    seen = starts.select("url", F.lit(0).alias("depth")).checkpoint()
    most = fetched.count()  # each step but the last reaches a page that was not seen
    jumps = _chain_jumps(edges, most)
    seen = _by_steps(edges, seen, most, max_depth) if (1 << len(jumps)) < LONG_CHAIN else _by_jumps(edges, jumps, seen)
    if max_depth is not None:
        seen = seen.filter(F.col("depth") < max_depth)
    rest = fetched.join(seen, "url", "left_anti").select("url", F.lit(None).cast("int").alias("depth"))
    ordered = seen.unionByName(rest).orderBy(F.col("depth").asc_nulls_last(), "url")
    return ordered if max_pages is None else ordered.limit(max_pages)


def _chain_jumps(edges: DataFrame, most: int) -> list[DataFrame]:
    """(origin, target, far) over 2, 4, 8 ... pages that each have one link only, as long as there are any."""
    hop = edges.groupBy("origin").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1").select("origin", "target").checkpoint()
    jumps: list[DataFrame] = []
    far = 2
    while far < most:
        on = hop.select(F.col("origin").alias("target"), F.col("target").alias("next"))
        hop = hop.join(on, "target").select("origin", F.col("next").alias("target")).checkpoint()
        if hop.isEmpty():
            break
        jumps.append(hop.withColumn("far", F.lit(far)))
        far *= 2
    return jumps


def _by_steps(edges: DataFrame, seen: DataFrame, most: int, max_depth: int | None) -> DataFrame:
    """Breadth first, a depth a step."""
    spark, frontier = edges.sparkSession, seen
    for depth in range(1, most + 2):
        if max_depth is not None and depth >= max_depth:
            return seen
        reached = frontier.join(edges, frontier["url"] == edges["origin"]).select(F.col("target").alias("url")).distinct()
        frontier = reached.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:  # one table again, so that many steps do not make a union of as many
            seen = seen.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))).checkpoint()
    raise RuntimeError(f"the frontier of {most} pages did not end")


def _by_jumps(edges: DataFrame, jumps: list[DataFrame], seen: DataFrame) -> DataFrame:
    """Least distances over links and jumps, bettered until none changes."""
    ways = reduce(DataFrame.unionByName, [edges.select("origin", "target", F.lit(1).alias("far")), *jumps])
    changed = seen
    while True:
        reached = changed.join(ways, changed["url"] == ways["origin"]).groupBy(F.col("target").alias("url")).agg(F.min(F.col("depth") + F.col("far")).alias("near"))
        better = reached.join(seen, "url", "left").filter("depth IS NULL OR near < depth").select("url", F.col("near").alias("depth")).checkpoint()
        if better.isEmpty():
            return seen
        seen = seen.join(better.select("url"), "url", "left_anti").unionByName(better).checkpoint()
        changed = better


def clean_article(html: str | None, drop_classes: tuple[str, ...] = ("ad",)) -> str:
    """Text of a page without elements of the given classes."""
    from quarrystone.functions.html import content_root, prune, text_of

    root = prune(parse(html), lambda element: bool(set(element.attrs.get("class", "").split()) & set(drop_classes)))
    return text_of(content_root(root), "keep")
