"""DOCX and XLSX from their XML parts, with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import groupby
from xml.etree import ElementTree as ET

from quillmark.errors import ParseFailure
from quillmark.functions.plain import one_line
from quillmark.operators.parsers.outline import Block, Outline, nested_lists

#: XML namespaces, limits, style names.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CORE = {"title": "{http://purl.org/dc/elements/1.1/}title", "author": "{http://purl.org/dc/elements/1.1/}creator", "subject": "{http://purl.org/dc/elements/1.1/}subject", "language": "{http://purl.org/dc/elements/1.1/}language", "created_at": "{http://purl.org/dc/terms/}created", "modified_at": "{http://purl.org/dc/terms/}modified"}
KEYWORDS = "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}keywords"
MAX_ROWS, MAX_COLUMNS = 5000, 64
HEADING_STYLE = re.compile(r"(?:heading|titre|berschrift)\D*(\d)")
TITLE_STYLES = {"title": 1, "subtitle": 2}
LIST_STYLE = re.compile(r"list (?:bullet|number|paragraph)")
DATE_FORMATS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 30, 36, 45, 46, 47, 50, 57])


class Package:
    """The parts of an Office file, each parsed on demand."""

    def __init__(self, data: bytes, kind: str):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            self.names = set(self.zip.namelist())
        except (zipfile.BadZipFile, OSError) as e:
            raise ParseFailure("corrupt", f"could not open as {kind}: {e}") from e
        self.kind = kind

    def part(self, name: str, needed: bool = False) -> ET.Element | None:
        if name not in self.names:
            if needed:
                raise ParseFailure("corrupt", f"could not open as {self.kind}: {name} is missing")
            return None
        try:
            return ET.fromstring(self.zip.read(name))
        except (ET.ParseError, zipfile.BadZipFile, OSError) as e:
            raise ParseFailure("corrupt", f"could not open as {self.kind}: {e}") from e

    def core(self) -> dict:
        root, meta = self.part("docProps/core.xml"), {}
        if root is None:
            return meta
        for key, tag in CORE.items():
            if (text := (root.findtext(tag) or "").strip()):
                meta[key] = text
        words = [x.strip() for x in re.split("[,;]", root.findtext(KEYWORDS) or "")]
        if any(words):
            meta["keywords"] = [x for x in words if x]
        return meta


def _text(p: ET.Element) -> str:
    """Text of a paragraph: runs, also those in links, with tabs and breaks."""
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
    out = []
    for run in p:
        for r in [run] if run.tag == f"{W}r" else run.findall(f"{W}r") if run.tag == f"{W}hyperlink" else []:
            out += [x.text or "" if x.tag == f"{W}t" else marks.get(x.tag, "") for x in r]
    return "".join(out)


def _value(p: ET.Element, path: str) -> str | None:
    """The w:val of an element below a paragraph's properties; empty where it has none, null without the element."""
    found = p.find("/".join(f"{W}{x}" for x in ("pPr", *path.split("/"))))
    return None if found is None else found.get(f"{W}val", "")


def style_levels(style: str) -> tuple[int | None, int | None]:
    """The level of a heading and of a list item, as far as the name of a style says."""
    m = HEADING_STYLE.match(style)
    heading = TITLE_STYLES.get(style, min(int(m[1]), 6) if m else None)
    number = re.sub(r"\D", "", style)
    return heading, max(int(number or 1) - 1, 0) if LIST_STYLE.search(style) else None


def style_names(styles: ET.Element | None) -> tuple[dict[str | None, str], str]:
    """Names of styles by id, in small letters, and that of a paragraph without one."""
    rows = [] if styles is None else [(s, s.find(f"{W}name")) for s in styles.findall(f"{W}style")]
    names = {s.get(f"{W}styleId"): ("" if name is None else name.get(f"{W}val", "")).strip().lower() for s, name in rows}
    defaults = [names[s.get(f"{W}styleId")] for s, _ in rows if s.get(f"{W}type") == "paragraph" and s.get(f"{W}default") in ("1", "true")]
    return names, defaults[-1] if defaults else ""


def body_rows(body: ET.Element, names: dict[str | None, str], default: str) -> Iterator[tuple[str, int, Block]]:
    """kind, level and block of every table and paragraph that holds text, in order.  A paragraph's own numbering says
    more of a list than its style, and a heading's style more than both."""
    for x in body:
        if x.tag == f"{W}tbl":
            rows = [[one_line(" ".join(_text(p) for p in cell.findall(f"{W}p"))) for cell in row.findall(f"{W}tc")] for row in x.findall(f"{W}tr")]
            yield "table", 0, Block("table", rows=rows if any(map(any, rows)) else None)
        elif x.tag == f"{W}p" and (text := one_line(_text(x))):
            own = _value(x, "pStyle")
            style = default if own is None else names.get(own or None, default)
            heading, item = style_levels(style)
            if x.find(f"{W}pPr/{W}numPr") is not None:
                level = _value(x, "numPr/ilvl") or ""
                item = max(int(level), 0) if re.fullmatch(r"-?\d+", level) else 0
            if heading is not None:
                yield "heading", heading, Block("heading", text, heading)
            elif item is not None:
                yield "list", item, Block("list_item", text, ordered="number" in style)
            else:
                yield "paragraph", 0, Block("paragraph", text)


def parse_docx(data: bytes) -> Outline:
    package = Package(data, "DOCX")
    body = package.part("word/document.xml", needed=True).find(f"{W}body")
    if body is None:
        raise ParseFailure("corrupt", "could not open as DOCX: it has no body")
    out = Outline("docx")
    for kind, rows in groupby(body_rows(body, *style_names(package.part("word/styles.xml"))), key=lambda row: row[0]):
        if kind == "list":
            lists = nested_lists([(level, item) for _, level, item in rows], below_last=False)
            todo = list(lists)
            for block in todo:
                for n, item in enumerate(block.children, 1):
                    item.number = n if item.ordered else None
                    todo += item.children
            blocks = lists
        else:
            blocks = [block for _, _, block in rows if kind != "table" or block.rows]
        for block in blocks:
            out.under_heading(block)
    out.meta |= package.core()
    if "title" not in out.meta and (title := out.opening_title()):
        out.meta["title"] = title
    return out


def _column(ref: str) -> int:
    n = 0
    for c in filter(str.isalpha, ref):
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _number(text: str, date: bool) -> str:
    value = float(text)
    if date:
        return str(datetime(1899, 12, 30) + timedelta(seconds=round(value * 86400)))
    return str(int(value)) if value.is_integer() else repr(value)


def parse_xlsx(data: bytes) -> Outline:
    package = Package(data, "XLSX")
    book = package.part("xl/workbook.xml", needed=True)
    links = package.part("xl/_rels/workbook.xml.rels")
    target = {x.get("Id"): x.get("Target", "") for x in (links if links is not None else [])}
    shared_part = package.part("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in (shared_part.findall(f"{S}si") if shared_part is not None else [])]
    styles = package.part("xl/styles.xml")
    formats = [int(x.get("numFmtId", 0)) for x in styles.findall(f"{S}cellXfs/{S}xf")] if styles is not None else []
    out = Outline("xlsx")
    for sheet in book.iter(f"{S}sheet"):
        name, path = sheet.get("name", ""), target.get(sheet.get(f"{R}id"), "")
        path = path.lstrip("/") if path.startswith("/") else f"xl/{path}"
        root = package.part(path)
        rows, cut = _sheet(root, shared, formats) if root is not None else ([], False)
        if not rows:
            out.warn("empty_sheet", f"sheet {name!r} contains no data and was skipped")
            continue
        out.roots.append(Block("heading", one_line(name), 1, children=[Block("table", rows=rows)]))
        if cut:
            out.warn("sheet_truncated", f"sheet {name!r} was truncated to {MAX_ROWS} rows and {MAX_COLUMNS} columns")
    title = one_line(package.core().get("title", ""))
    out.meta["title"] = title or (out.roots[0].text if out.roots else None)
    return out


def _sheet(root: ET.Element, shared: list[str], formats: list[int]) -> tuple[list[list[str]], bool]:
    """Rows of cell texts without the empty rows and columns at their ends, and whether a limit cut them."""
    rows: list[list[str]] = []
    cut = False
    for row in root.iter(f"{S}row"):
        at = int(row.get("r", len(rows) + 1)) - 1
        if at >= MAX_ROWS:
            cut = True
            break
        rows += [[] for _ in range(at - len(rows))]
        cells: list[str] = []
        for c in row.findall(f"{S}c"):
            place = _column(c.get("r")) if c.get("r") else len(cells)
            if place >= MAX_COLUMNS:
                cut = True
                break
            cells += [""] * (place - len(cells))
            cells.append(_cell(c, shared, formats))
        rows.append(cells)
    while rows and not any(rows[-1]):
        rows.pop()
    width = max((i + 1 for r in rows for i, x in enumerate(r) if x), default=0)
    return [(r + [""] * width)[:width] for r in rows], cut


def _cell(c: ET.Element, shared: list[str], formats: list[int]) -> str:
    kind, value = c.get("t", "n"), c.findtext(f"{S}v")
    if kind == "inlineStr":
        return one_line("".join(t.text or "" for t in c.iter(f"{S}t")))
    if value is None:
        return ""
    if kind == "s":
        return one_line(shared[int(value)]) if int(value) < len(shared) else ""
    if kind == "b":
        return "true" if value.strip() == "1" else "false"
    if kind == "n":
        style = int(c.get("s", 0))
        try:
            return _number(value, style < len(formats) and formats[style] in DATE_FORMATS)
        except ValueError:
            return one_line(value)
    return one_line(value)
