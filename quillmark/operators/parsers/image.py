"""Images: a page of recognised lines, by a reader that the caller gives."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from quillmark.errors import ParseFailure
from quillmark.operators.parsers.outline import Block, Outline

#: Resolution that readers are asked for, confidence below which a page is doubtful, longest title.
DPI, LOW_CONFIDENCE, MAX_TITLE = 200, 0.55, 120


@dataclass
class Line:
    text: str
    confidence: float | None = None
    left: float = 0.0
    top: float = 0.0
    right: float = 0.0
    bottom: float = 0.0


Reader = Callable[[bytes, int], tuple[list[Line], float | None]]


def parse(data: bytes, read: Reader | None) -> Outline:
    if read is None:
        raise ParseFailure("ocr_unavailable", "this document is an image and no OCR backend is configured, so it has no readable content")
    lines, confidence = read(data, DPI)
    if not lines:
        raise ParseFailure("corrupt", "no text could be recognised in this image")
    out = Outline("image")
    out.roots = [Block("paragraph", x.text, page=1, confidence=x.confidence) for x in lines]
    out.pages[1] = ("ocr", confidence)
    if confidence is not None and confidence < LOW_CONFIDENCE:
        out.warn("low_ocr_confidence", f"the image was recognised at {confidence:.2f} confidence; quotes taken from this document may not match its text exactly")
    out.meta |= {"page_count": 1, "has_text_layer": False, "ocr_applied": True, "ocr_page_count": 1}
    if 0 < len(lines[0].text) <= MAX_TITLE:
        out.meta["title"] = lines[0].text
    return out
