"""Files as a sink: cleaned pages under unique readable paths, and logs that are cut by size, written in two phases.

A Python data source writer gives each task attempt a folder of its own inside the job's version.  When all tasks are done, the commit lists the
folders of those that won, removes what other attempts left, and claims the next pointer; until then no reader sees any of it.  A job
that fails takes its version away.  Each task writes the manifest of its own files, so the driver only ever holds a line a task.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape
from urllib.parse import unquote_plus, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quarrystone import store
from quarrystone.functions.html import VOID, Node, page_title, parse, prune
from quarrystone.session import prepare

FORMAT = "exported_files"
#: Elements and classes that an exported article leaves out, and the names that some file systems keep for themselves.
LEFT_OUT = {"script", "style", "noscript", "nav", "header", "footer", "form", "iframe"}
LEFT_OUT_CLASSES = {"xwikitabbar", "xwiki-async", "hidden", "comment", "comments", "metadata"}
RESERVED = {"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))}
#: Longest part of a path, and longest path.
PART_CHARS, PATH_CHARS = 90, 230


def article_root(root: Node) -> Node:
    """The element that holds the content: by its id, then by its class, else the body."""
    inside = lambda name: next((n for n in root.walk() if n.attrs.get("id") == name), None) or next((n for n in root.walk() if name in n.attrs.get("class", "").split()), None)
    return inside("xwikicontent") or root.find("body") or root


def article_html(root: Node) -> str:
    """A page's content as HTML without what is no article and without event handlers."""
    inner = prune(article_root(root), lambda n: n.tag in LEFT_OUT or bool(LEFT_OUT_CLASSES & set(n.attrs.get("class", "").split())))
    out: list[str] = []
    ahead: list[Node | str] = [inner]
    while ahead:
        item = ahead.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        if item.tag:
            out.append(f"<{item.tag}{''.join(f' {k}="{escape(v)}"' for k, v in item.attrs.items() if not k.startswith('on'))}>")
            if item.tag not in VOID:
                ahead.append(f"</{item.tag}>")
        ahead.extend(escape(c, quote=False) if isinstance(c, str) else c for c in reversed(item.children))
    return "".join(out)


def path_part(name: str, fallback: str, longest: int = PART_CHARS) -> str:
    """A name as one part of a path: decoded, without characters that file systems refuse; a cut one ends in a digest of all of it."""
    name = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", re.sub(r"\s+", " ", unquote_plus(name).strip())).strip(" .") or fallback
    if name.lower() in RESERVED:
        name += "_"
    return name if len(name) <= longest else f"{name[: longest - 9].rstrip()}-{hashlib.sha1(name.encode()).hexdigest()[:8]}"


def readable_path(url: str, title: str) -> str:
    """Folders of the address and the title as the file's name."""
    parts = [p for p in urlsplit(url).path.removeprefix("/bin/view/").split("/") if p] or ["Main"]

    def told(folder_chars: int, file_chars: int) -> str:
        names = [path_part(p, "section", folder_chars) for p in parts]
        return "/".join([*names[:-1], path_part(title or names[-1], names[-1], file_chars) + ".html"])

    path = told(PART_CHARS, PART_CHARS)
    return path if len(path) <= PATH_CHARS else told(48, 64)


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """(page_id, path, content) of every page; of pages with the same path the first keeps it, the others get a digest of their address."""
    prepare(pages.sparkSession, 256)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                root, url = parse(html), url or ""
                title = re.sub(r"\s+-\s+XWiki\s*$", "", page_title(root, "")).strip() or f"page {page_id}"
                body = f"<article>\n<h1>{escape(title)}</h1>\n<p><a href=\"{escape(url)}\">{escape(url)}</a></p>\n{article_html(root)}\n</article>"
                rows.append((page_id, url, readable_path(url, title), f"<!doctype html>\n<title>{escape(title)}</title>\n{body}\n"))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["page_id", "url", "path", "content"])

    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(clean, "page_id bigint, url string, path string, content string")
    return unique_paths(rows, "path", "page_id", "url").select("page_id", "path", "content")


def unique_paths(rows: DataFrame, path: str, order: str, digested: str) -> DataFrame:
    """Of rows with the same path the first in ``order`` keeps it; the others get 16 digits of a digest before the ending."""
    firsts = rows.groupBy(path).agg(F.min(order).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    digest = F.substring(F.sha1(F.coalesce(F.concat_ws(" ", F.col(digested), F.col(order).cast("string")), F.lit("")).cast("binary")), 1, 16)
    stem, ending = F.regexp_replace(path, r"\.[^./]*$", ""), F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return rows.join(firsts, path, "left").withColumn(path, F.when(F.col("_first").isNull() | (F.col("_first") == F.col(order)), F.col(path)).otherwise(F.concat(stem, F.lit("-"), digest, ending))).drop("_first")


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class FileWriter(DataSourceWriter):
    """Rows (path, content): a file each or, with ``most`` bytes, lines of files that are cut before they grow larger than that."""

    def __init__(self, version: str, most: int):
        self.version, self.most = version, most

    def write(self, rows: Iterator) -> Written:
        task = TaskContext.get()
        name = f"{task.partitionId()}-{task.taskAttemptId()}"
        system, root = _opened(f"{self.version}/{name}")
        system.create_dir(root)
        manifest: list[tuple[str, str, int, str]] = []
        open_: dict[str, list] = {}  # path: number of its files, and the lines and bytes of the last

        def put(path: str, content: bytes) -> None:
            target = f"{root}/{path}"
            system.create_dir(target.rpartition("/")[0])
            with system.open_output_stream(target) as file:
                file.write(content)
            manifest.append((path, f"{name}/{path}", len(content), hashlib.sha256(content).hexdigest()))

        def cut(path: str) -> None:
            number, lines, _ = open_[path]
            stem, dot, ending = path.rpartition(".")
            put(f"{stem}-{task.partitionId():05d}-{number:04d}{dot}{ending}", b"".join(lines))
            open_[path] = [number + 1, [], 0]

        for row in rows:
            if row.path is None or row.content is None:
                raise ValueError("a file needs a path and a content")
            if not self.most:
                put(row.path, row.content.encode())
                continue
            line = row.content.encode() + b"\n"
            held = open_.setdefault(row.path, [0, [], 0])
            if held[2] and held[2] + len(line) > self.most:
                cut(row.path)
                held = open_[row.path]
            held[1].append(line)
            held[2] += len(line)
        for path in [p for p, held in open_.items() if held[2]]:
            cut(path)
        columns = list(zip(*manifest, strict=True)) or [()] * 4
        kinds = [("path", pa.string()), ("location", pa.string()), ("bytes", pa.int64()), ("sha256", pa.string())]
        pq.write_table(pa.table([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds]), f"{root}/manifest.parquet", filesystem=system)
        return Written(name, len(manifest))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.version)
        won = {m.folder: m.files for m in messages if m}
        for info in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name not in won:  # of an attempt that was tried again
                system.delete_dir(info.path)
        system.create_dir(root)
        with system.open_output_stream(f"{root}/committed.json") as file:
            file.write(json.dumps(won).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.version)
        if system.get_file_info(root).type != pafs.FileType.NotFound:
            system.delete_dir(root)


class ExportedFiles(DataSource):
    """``df.write.format("exported_files").option("version", folder)`` for rows (path, content)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["version"], int(self.options.get("most", 0)))


def export(rows: DataFrame, root: str, most_bytes: int = 0) -> int:
    """Write (path, content) as a new version below ``root`` and make it the current one; returns its number.

    Paths must be unique (``unique_paths``) unless files are cut by size, as their lines then share a path.
    """
    spark = rows.sparkSession
    prepare(spark)
    spark.dataSource.register(ExportedFiles)
    root = root.rstrip("/")
    version = f"{root}/version-{uuid.uuid4().hex}"
    rows.select("path", "content").write.format(FORMAT).option("version", version).option("most", str(most_bytes)).mode("append").save()
    return store.publish(spark, root, version)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, location, bytes, sha256) of the current version's files; locations are below its folder."""
    version = store.current(spark, root)
    won = json.loads(spark.read.text(f"{version}/committed.json", wholetext=True).first()[0]) if version else {}
    schema = "path string, location string, bytes bigint, sha256 string"
    return spark.read.schema(schema).parquet(*[f"{version}/{folder}/manifest.parquet" for folder in won]) if won else spark.createDataFrame([], schema)
