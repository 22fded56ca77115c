"""Word packages by their structure: paragraphs under the headings that their styles make, then the rows of tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

#: Fixed value: the XML name space of word processing documents.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: What elements inside a paragraph stand for.
MARKS = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}


def _told(element: ElementTree.Element) -> str:
    return "".join((e.text or "") if e.tag == f"{W}t" else MARKS.get(e.tag, "") for e in element.iter())


def heading_levels(styles: bytes | None) -> dict[str, int]:
    """Style ids that make headings, with their level: named "heading n", or based on one that is, through any number of styles."""
    named: dict[str, str] = {}
    based: dict[str, str] = {}
    for style in ElementTree.fromstring(styles).iter(f"{W}style") if styles else ():
        key = style.get(f"{W}styleId", "")
        name, parent = style.find(f"{W}name"), style.find(f"{W}basedOn")
        named[key] = name.get(f"{W}val", "") if name is not None else ""
        if parent is not None:
            based[key] = parent.get(f"{W}val", "")
    levels = {}
    for key in named:
        at, seen = key, set()
        while at in named and at not in seen:  # a circle of styles makes no heading
            seen.add(at)
            if named[at].lower().startswith("heading"):
                levels[key] = int("".join(filter(str.isdigit, named[at])) or 1)
                break
            at = based.get(at, "")
    return levels


def body_parts(document) -> Iterator[tuple[str, str, str]]:
    """(kind, style id, text) of the body's own paragraphs and table rows in document order, read as a stream and let go of at once."""
    depth = 0
    for event, element in ElementTree.iterparse(document, ("start", "end")):
        if event == "start":
            depth += 1
            continue
        depth -= 1
        if depth != 2:  # children of the body
            continue
        if element.tag == f"{W}p":
            style = element.find(f"{W}pPr/{W}pStyle")
            yield "paragraph", style.get(f"{W}val", "") if style is not None else "", _told(element).strip()
        elif element.tag == f"{W}tbl":
            for row in element.findall(f"{W}tr"):
                cells = ("\n".join(_told(p) for p in cell.findall(f"{W}p")).strip() for cell in row.findall(f"{W}tc"))
                yield "row", "", " | ".join(cell for cell in cells if cell)
        element.clear()


def docx_blocks(content: bytes, title: str = "") -> list[tuple[str, str, str, list[str]]]:
    """Blocks (text, section, kind, headings): paragraphs in order, each under its headings, then all table rows under the last ones.

    The title stands where no heading of level 1 has replaced it.
    """
    package = zipfile.ZipFile(io.BytesIO(content))
    levels = heading_levels(package.read("word/styles.xml") if "word/styles.xml" in package.namelist() else None)
    above: list[str] = [title] if title else []
    blocks, rows = [], []
    with package.open("word/document.xml") as document:
        for kind, style, text in body_parts(document):
            if kind == "row":
                rows.append(text)
                continue
            if not text:
                continue
            if level := levels.get(style, 0):
                above = [*above[: level - 1], *[""] * (level - 1 - len(above)), text]
            blocks.append((text, "heading" if level else "text", above))
    blocks += [(row, "table_row", above) for row in rows if row]
    return [(text, " → ".join(x for x in under if x.strip()), kind, list(under)) for text, kind, under in blocks]


def docx_package(paragraphs: list[tuple[str, str]], styles: list[tuple[str, str, str]] = ()) -> bytes:
    """A minimal package of (style id, text) paragraphs and (style id, name, based on) styles."""
    space = f'xmlns:w="{W.strip("{}")}"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{escape(style)}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>' for style, text in paragraphs)
    told = "".join(f'<w:style w:styleId="{escape(key)}"><w:name w:val="{escape(name)}"/>{f"<w:basedOn w:val={chr(34)}{escape(parent)}{chr(34)}/>" if parent else ""}</w:style>' for key, name, parent in styles)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
        package.writestr("word/styles.xml", f"<w:styles {space}>{told}</w:styles>")
    return out.getvalue()
