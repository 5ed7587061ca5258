"""Format parsers: bytes of one document to an ``Outline``.  They know nothing of Spark."""

from __future__ import annotations

from collections.abc import Callable

from quillmark.errors import ParseFailure
from quillmark.operators.parsers import delimited, image, markdown, markup, office
from quillmark.operators.parsers.outline import Outline

Parser = Callable[[bytes], Outline]
TEXT = ("text/plain", "text/markdown", "text/x-markdown", "application/markdown")
IMAGES = ("image/png", "image/jpeg", "image/tiff", "image/bmp", "image/gif", "image/webp")
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
VERSION = "1.0"


def registry(ocr: image.Reader | None = None) -> dict[str, tuple[str, Parser]]:
    """Media type to (parser name, parser).  ocr reads an image into lines; without it images can't be parsed."""
    known: dict[str, tuple[str, Parser]] = {x: ("text", markdown.parse) for x in TEXT}
    known |= {x: ("html", markup.parse) for x in ("text/html", "application/xhtml+xml")}
    known |= {x: ("csv", delimited.parse) for x in ("text/csv", "text/tab-separated-values")}
    known |= {DOCX: ("docx", office.parse_docx), XLSX: ("xlsx", office.parse_xlsx)}
    known |= {x: ("image", lambda data: image.parse(data, ocr)) for x in IMAGES}
    return known


def parse(data: bytes, media_type: str, known: dict[str, tuple[str, Parser]]) -> tuple[str, Outline]:
    if media_type not in known:
        raise ParseFailure("unsupported_format", f"no parser for {media_type}")
    name, parser = known[media_type]
    return name, parser(data)
