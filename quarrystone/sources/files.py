"""Files as a source: recursive scans, text and Office readers, archives, JSON lines.

A file that can't be read gives a row with an error and no text; it never stops a scan.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.html import page_text, squeeze
from quarrystone.functions.text import extension
from quarrystone.session import prepare

#: XML name spaces of Office packages.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DC = "{http://purl.org/dc/elements/1.1/}"


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("html", "htm", "txt", "docx", "xlsx", "pptx")) -> DataFrame:
    """(path, modified_at, size_bytes, file_type, content) of all files below a folder, without temporary ones.

    Extensions are matched in either case.  Contents are read only where they are used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = files.withColumn("file_type", extension("path")).filter(F.col("file_type").isin(*extensions) & ~F.col("path").rlike(r"/(~\$|\.)[^/]*$"))
    return kept.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"), "file_type", "content")


def _core_title(package: zipfile.ZipFile) -> str:
    if "docProps/core.xml" not in package.namelist():
        return ""
    title = ElementTree.fromstring(package.read("docProps/core.xml")).find(f"{DC}title")
    return (title.text or "").strip() if title is not None else ""


def read_docx(content: bytes, name: str) -> tuple[str, str]:
    """Paragraphs, then table rows with their cells joined; the title is stated or the first paragraph's head."""
    package = zipfile.ZipFile(io.BytesIO(content))
    body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{W}body")
    told = lambda node: "".join(t.text or "" for t in node.iter(f"{W}t"))
    paragraphs = [text for p in body.findall(f"{W}p") if (text := told(p).strip())]
    rows = [" | ".join(told(c).strip() for c in row.findall(f"{W}tc")) for table in body.findall(f"{W}tbl") for row in table.findall(f"{W}tr")]
    return _core_title(package) or (paragraphs[0][:100] if paragraphs else name), squeeze("\n".join(paragraphs + rows))


def sheets_in_order(package: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(title, member) of a workbook's sheets as it lists them, by their relationship ids; by their numbers where it has none."""
    listed = list(ElementTree.fromstring(package.read("xl/workbook.xml")).iter(f"{S}sheet"))
    numbered = sorted((x for x in package.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)), key=lambda x: int(re.search(r"\d+", x)[0]))
    targets = {}
    if "xl/_rels/workbook.xml.rels" in package.namelist():
        for link in ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels")):
            target = link.get("Target", "")
            targets[link.get("Id", "")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    members = [targets.get(sheet.get(f"{R}id", "")) for sheet in listed]
    if not all(member in package.namelist() for member in members):
        members = numbered
    return list(zip((sheet.get("name", "") for sheet in listed), members, strict=False))


def read_xlsx(content: bytes, name: str) -> tuple[str, str]:
    """Every sheet with a header line; empty cells keep their place."""
    package = zipfile.ZipFile(io.BytesIO(content))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in package.namelist():
        shared = ["".join(t.text or "" for t in item.iter(f"{S}t")) for item in ElementTree.fromstring(package.read("xl/sharedStrings.xml"))]
    lines = []
    for title, sheet in sheets_in_order(package):
        lines.append(f"Sheet: {title}")
        for row in ElementTree.fromstring(package.read(sheet)).iter(f"{S}row"):
            cells = []
            for cell in row.findall(f"{S}c"):
                value = cell.find(f"{S}v")
                inline = "".join(t.text or "" for t in cell.iter(f"{S}t"))
                text = value.text if value is not None and value.text else inline
                cells.append(shared[int(text)] if cell.get("t") == "s" and text else text)
            lines.append(" | ".join(cells))
    return _core_title(package) or name, squeeze("\n".join(lines))


def read_pptx(content: bytes, name: str) -> tuple[str, str]:
    """Slides with their numbers; the title is the first text of the first slide."""
    package = zipfile.ZipFile(io.BytesIO(content))
    slides = sorted((x for x in package.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", x)), key=lambda x: int(re.search(r"\d+", x)[0]))
    title, lines = "", []
    for n, slide in enumerate(slides, 1):
        texts = ["".join(t.text or "" for t in p.iter(f"{A}t")).strip() for p in ElementTree.fromstring(package.read(slide)).iter(f"{A}p")]
        texts = [t for t in texts if t]
        if n == 1 and texts:
            title = texts[0]
        lines.append(f"Slide {n}: " + " ".join(texts))
    return title or name, squeeze("\n".join(lines))


def read_text(content: bytes, name: str) -> tuple[str, str]:
    return name, squeeze(content.decode("utf-8", "replace"))


def read_html(content: bytes, name: str) -> tuple[str, str]:
    return page_text(content.decode("utf-8", "replace"), name)


READERS: dict[str, Callable[[bytes, str], tuple[str, str]]] = {"docx": read_docx, "xlsx": read_xlsx, "pptx": read_pptx, "txt": read_text, "html": read_html, "htm": read_html}


def extract(files: DataFrame, readers: dict[str, Callable[[bytes, str], tuple[str, str]]] | None = None) -> DataFrame:
    """(path, title, text, error) by the reader of each file's type; readers can be replaced or added."""
    known = READERS | (readers or {})
    prepare(files.sparkSession, 64)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows.append((path, *known[kind](content or b"", PurePosixPath(path).stem), None))
                except (KeyError, ValueError, IndexError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    rows.append((path, None, None, f"{type(error).__name__}: {error}"))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["path", "title", "text", "error"])

    return files.select("path", "file_type", "content").mapInArrow(read, "path string, title string, text string, error string")


def archive_members(files: DataFrame, largest: int = 256 * 1024 * 1024) -> DataFrame:
    """(path, member, content, error) of ZIP files: names are percent-decoded, and parts that lead upwards are dropped.

    An archive or a member that can't be read, or a member of over ``largest`` bytes, is a row with an error and no content.
    """
    prepare(files.sparkSession, 16)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(path: str, member: str | None, content: bytes | None, error: str | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([member], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["path", "member", "content", "error"])

        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    package = zipfile.ZipFile(io.BytesIO(content or b""))
                except zipfile.BadZipFile as error:
                    yield row(path, None, None, f"BadZipFile: {error}")
                    continue
                for info in package.infolist():
                    name = "/".join(p for p in unquote(info.filename).replace("\\", "/").split("/") if p not in ("", ".", ".."))
                    if not name or info.is_dir():
                        continue
                    if info.file_size > largest:
                        yield row(path, name, None, f"{info.file_size} bytes are more than {largest}")
                        continue
                    try:
                        yield row(path, name, package.read(info), None)
                    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as error:  # damaged, of an unknown method, or encrypted
                        yield row(path, name, None, f"{type(error).__name__}: {error}")

    return files.select("path", "content").mapInArrow(read, "path string, member string, content binary, error string")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file; blank, malformed and non-object lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).na.drop("all")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """A folder of JSON-lines files that ``read_json_lines`` reads again; nulls are left out of their objects."""
    rows.write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str, stage: str = "stage") -> None:
    """An exchange log: JSON lines, one folder a stage."""
    rows.write.mode("append").partitionBy(stage).json(path)


def inside(root: str, path: str) -> str:
    """The path below the root; a path that leads out of it is an error."""
    parts: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            if not parts:
                raise ValueError(f"{path!r} leads out of the data folder")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return f"{root.rstrip('/')}/{'/'.join(parts)}"
