"""A document under construction: blocks with a parent, numbered in document order when it is done."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Block:
    kind: str
    text: str = ""
    depth: int = 0
    page: int | None = None
    rows: list[list[str]] | None = None
    header_rows: int = 1
    confidence: float | None = None
    ordered: bool | None = None
    number: int | None = None
    lang: str | None = None
    children: list[Block] = field(default_factory=list)


def nested_lists(items: Iterable[tuple[int, Block]], below_last: bool) -> list[Block]:
    """Lists of items with their indentation; the outermost are returned.

    An item belongs to the innermost list that is not indented further.  Where it is itself indented further than
    that list it starts one below the item before it (below_last) or below the last item of that list.
    """
    roots: list[Block] = []
    indents: list[int] = []
    at_depth: dict[int, Block] = {}
    last: Block | None = None
    for indent, item in items:
        del indents[bisect_right(indents, indent) :]
        if not indents or indents[-1] < indent:
            made = Block("list", ordered=item.ordered)
            above = at_depth[len(indents)] if indents else None
            home = roots if above is None else (last if below_last else above.children[-1]).children
            home.append(made)
            indents.append(indent)
            at_depth[len(indents)] = made
        item.depth = len(indents)
        at_depth[item.depth].children.append(item)
        last = item
    return roots


class Outline:
    """Roots, open headings, metadata, page information and warnings."""

    def __init__(self, form: str):
        self.roots: list[Block] = []
        self.headings: list[Block] = []
        self.meta: dict[str, Any] = {"format": form}
        self.pages: dict[int, tuple[str, float | None]] = {}
        self.warnings: list[tuple[str, str, int | None]] = []

    def warn(self, code: str, message: str, page: int | None = None) -> None:
        self.warnings.append((code, message, page))

    def under_heading(self, block: Block) -> Block:
        """Put a block below the open heading; a heading first closes those that are not above it."""
        if block.kind == "heading":
            while self.headings and self.headings[-1].depth >= block.depth:
                self.headings.pop()
        (self.headings[-1].children if self.headings else self.roots).append(block)
        if block.kind == "heading":
            self.headings.append(block)
        return block

    def opening_title(self) -> str | None:
        """The first root block's text, if it is a heading."""
        return self.roots[0].text or None if self.roots and self.roots[0].kind == "heading" else None

    def rows(self) -> list[dict[str, Any]]:
        """Blocks in document order, parents first, without those that hold no text.

        last is the number of the last descendant, first whether a block is its parent's first child, and the page is
        its parent's where a block has none.
        """
        out: list[dict[str, Any]] = []

        order = list(self.roots)
        for b in order:
            order += b.children
        empty: set[int] = set()
        for b in reversed(order):  # children before their parents
            b.children = [c for c in b.children if id(c) not in empty]
            own = b.kind in ("heading", "list_item", "code") or bool(b.rows) or (b.kind not in ("list", "table") and bool(b.text.strip()))
            if not (own or b.children):
                empty.add(id(b))

        todo = [(b, None, i == 0) for i, b in reversed(list(enumerate(x for x in self.roots if id(x) not in empty)))]
        parents: list[int] = []
        while todo:
            b, parent, first = todo.pop()
            at = len(out)
            page = b.page if b.page is not None else None if parent is None else out[parent]["page"]
            out.append({"ordinal": at, "parent": parent, "last": at, "type": b.kind, "depth": b.depth, "page": page, "raw": b.text, "rows": b.rows, "header_rows": b.header_rows if b.rows is not None else None, "confidence": b.confidence, "ordered": b.ordered, "number": b.number, "lang": b.lang, "first": first})
            parents.append(-1 if parent is None else parent)
            todo += [(c, at, i == 0) for i, c in reversed(list(enumerate(b.children)))]
        for at in range(len(out) - 1, 0, -1):
            if parents[at] >= 0:
                out[parents[at]]["last"] = max(out[parents[at]]["last"], out[at]["last"])
        return out
