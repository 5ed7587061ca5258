"""Page layout over rows of lines and words: what a PDF's structure is inferred from, as aggregates and windows.

lines: document_id, page, seq, text, size, indent, right, top, bottom, confidence (y grows upward).
words: document_id, page, idx, text, conf, block_num, par_num, line_num, left, top, width, height.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.plain import one_line, unwrap
from quillmark.functions.text import clean_inline, strip
from quillmark.operators.parse import BLOCK
from quillmark.operators.parsers.outline import Block, Outline

#: Fixed values of the inference.
MIN_PAGE_CHARS, HEADING_RATIO, MAX_HEADING, TIER_TOLERANCE, GAP_RATIO, MAX_TIERS, MIN_WORD = 80, 1.18, 120, 0.04, 1.6, 6, 30.0
BULLETS = "•▪◦‣⁃·"
DASHES = ("- ", "– ", "— ", "* ")
PLACEHOLDERS = ("untitled", "unknown", "anonymous", "none", "null", "n/a", "na", "-", "--", "()", "unspecified", "no title", "default", "microsoft word", "document1")


def is_bullet(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(f"^[{BULLETS}]|^[-–—*] ")), F.lit(False))


def ocr_lines(words: DataFrame) -> DataFrame:
    """Recognised words to lines: doubtful and blank words go, the others join in order; unknown confidence is null."""
    kept = words.where((strip(F.col("text")) != "") & ((F.col("conf") == -1) | (F.col("conf") >= MIN_WORD)))
    known = F.when(F.col("conf") != -1, F.col("conf"))
    lines = kept.groupBy("document_id", "page", "block_num", "par_num", "line_num").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", strip(F.col("text")).alias("word")))), lambda x: x["word"]), " ").alias("joined"),
        (F.avg(known) / 100).alias("confidence"), F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"),
    )
    return lines.withColumn("text", clean_inline(F.col("joined"))).where("text <> ''").drop("joined")


def to_points(lines: DataFrame, dpi: float, page_height: Column) -> DataFrame:
    """Pixels from the top left to points from the bottom left."""
    scale = dpi / 72.0
    y = lambda c: page_height - F.col(c) / scale
    return lines.select("*", (F.col("left") / scale).alias("indent"), (F.col("right") / scale).alias("right_pt"), y("top").alias("top_pt"), y("bottom").alias("bottom_pt"))


def reconstruct_lines(chars: DataFrame) -> DataFrame:
    """Glyphs (document_id, page, seq, char, size, left, right, top, bottom) to lines, cut at line ends."""
    w = Window.partitionBy("document_id", "page").orderBy("seq")
    ends = F.col("char").isin("\r", "\n").cast("int")
    rows = chars.withColumn("line", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(~F.col("char").isin("\r", "\n"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "char"))), lambda x: x["char"]), "")
    lines = rows.groupBy("document_id", "page", "line").agg(text.alias("text"), F.expr("percentile(size, 0.5)").alias("size"), F.min("left").alias("indent"), F.max("right").alias("right"), F.max("top").alias("top"), F.min("bottom").alias("bottom"))
    return lines.where(strip(F.col("text")) != "")


def ocr_decision(lines: DataFrame, images: DataFrame) -> DataFrame:
    """What to do with each page: 'ocr' if it has images and few characters, 'blank_page' if it has neither.

    images: document_id, page, n_images; one row for each page.
    """
    chars = lines.groupBy("document_id", "page").agg(F.sum(F.length("text")).alias("chars"))
    n = F.coalesce("chars", F.lit(0))
    return images.join(chars, ["document_id", "page"], "left").select("document_id", "page", n.alias("chars"), F.when((n < MIN_PAGE_CHARS) & (F.col("n_images") > 0), "ocr").when(n == 0, "blank_page").otherwise("text_layer").alias("decision"))


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines that no ruled table (document_id, page, top, bottom, left, right) covers."""
    t = tables.select(F.col("document_id").alias("td"), F.col("page").alias("tp"), F.col("top").alias("tt"), F.col("bottom").alias("tb"), F.col("left").alias("tl"), F.col("right").alias("tr"))
    centre = (F.col("top") + F.col("bottom")) / 2
    covers = (F.col("document_id") == F.col("td")) & (F.col("page") == F.col("tp")) & centre.between(F.col("tb") - 1, F.col("tt") + 1) & (F.col("right") >= F.col("tl") - 2) & (F.col("indent") <= F.col("tr") + 2)
    return lines.join(t, covers, "left_anti")


def body_size(lines: DataFrame) -> DataFrame:
    """The size, to a tenth, that most characters of a document have; of equals the one that comes first."""
    by_size = lines.groupBy("document_id", F.round("size", 1).alias("body_size")).agg(F.sum(F.length("text")).alias("chars"), F.min(F.struct("page", "seq")).alias("first"))
    best = Window.partitionBy("document_id").orderBy(F.desc("chars"), "first")
    return by_size.withColumn("n", F.row_number().over(best)).where("n = 1").select("document_id", "body_size")


def heading_tiers(lines: DataFrame) -> DataFrame:
    """document_id and tiers: heading sizes, largest first; sizes within the tolerance of a tier belong to it."""
    large = lines.join(body_size(lines), "document_id").where((F.col("size") >= HEADING_RATIO * F.col("body_size")) & (F.length("text") <= MAX_HEADING) & ~is_bullet(F.col("text")))
    sizes = large.groupBy("document_id").agg(F.sort_array(F.collect_set(F.round("size", 2)), asc=False).alias("sizes"))
    near = lambda a, b: F.abs(a - b) <= TIER_TOLERANCE * b
    tiers = F.aggregate("sizes", F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) > 0) & near(x, F.element_at(acc, -1)), acc).otherwise(F.concat(acc, F.array(x))))
    return sizes.select("document_id", F.slice(tiers, 1, MAX_TIERS).alias("tiers"))


def heading_level(size: Column, tiers: Column) -> Column:
    """Rank of the first tier within the tolerance, or null."""
    hit = F.array_position(F.transform(tiers, lambda t: F.abs(size - t) <= TIER_TOLERANCE * t), F.lit(True))
    return F.when(hit > 0, hit.cast("int"))


def gap_threshold(lines: DataFrame) -> DataFrame:
    """document_id and threshold: the gap above which a paragraph ends; infinite where no gap is positive."""
    w = Window.partitionBy("document_id").orderBy("page", "seq")
    gaps = lines.select("document_id", F.when(F.lead("page").over(w) == F.col("page"), F.lead("bottom").over(w) - F.col("top")).alias("gap"))
    median = F.expr("percentile(CASE WHEN gap > 0 THEN gap END, 0.5)")
    return gaps.groupBy("document_id").agg(F.coalesce(median * GAP_RATIO + 0.5, F.lit(float("inf"))).alias("threshold"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines with the number of their paragraph: one ends at a page or where the gap exceeds the threshold."""
    w = Window.partitionBy("document_id").orderBy("page", "seq")
    rows = lines.join(gap_threshold(lines), "document_id")
    breaks = F.coalesce((F.lag("page").over(w) != F.col("page")) | (F.lag("bottom").over(w) - F.col("top") > F.col("threshold")), F.lit(False))
    return rows.withColumn("starts", breaks.cast("int")).withColumn("paragraph", F.sum("starts").over(w)).drop("starts")


def clean_metadata(value: Column) -> Column:
    """A producer's way of writing nothing becomes null."""
    text = strip(value)
    return F.when((text != "") & ~F.lower(text).isin(*PLACEHOLDERS), text)


def bullet_text(text: str) -> str | None:
    if text[:1] and text[0] in BULLETS:
        return text[1:].strip()
    return text[2:].strip() if text.startswith(DASHES) else None


def _role(line: dict) -> str:
    """A bullet makes an item, else a level makes a heading."""
    if bullet_text(line["text"]) is not None:
        return "item"
    return "text" if line["level"] is None or line["level"] != line["level"] else "heading"


def _block(role: str, run: list[dict]) -> Block:
    """One block of neighbours with the same role."""
    page = run[0]["page"]
    if role == "table":
        return Block("table", page=page, rows=[list(r) for r in run[0]["rows"]])
    if role == "heading":
        return Block("heading", one_line(run[0]["text"]), int(run[0]["level"]), page=page)
    if role == "item":
        items = [Block("list_item", one_line(bullet_text(x["text"])), 1, page=x["page"], ordered=False, confidence=x["confidence"]) for x in run]
        return Block("list", page=page, ordered=False, children=items)
    known = [x["confidence"] for x in run if x["confidence"] is not None and x["confidence"] == x["confidence"]]
    return Block("paragraph", unwrap("\n".join(x["text"] for x in run)), page=page, confidence=sum(known) / len(known) if known else None)


def outline(rows: list[dict], tables: list[dict]) -> Outline:
    """Lines (with level and paragraph) and tables of one document, in order, to headings, lists and paragraphs.

    Neighbours form a block if they are lines of text in one paragraph, or items; of a table and a line at the same
    height the line comes first.
    """
    out = Outline("pdf")
    placed = [(_role(r), r) for r in rows] + [("table", t) for t in tables]
    placed.sort(key=lambda x: (x[1]["page"], -x[1]["top"], x[0] == "table"))
    together = {"text": lambda x, at: x["paragraph"], "item": lambda x, at: None}
    keyed = [(role, together.get(role, lambda x, at: at)(x, at)) for at, (role, x) in enumerate(placed)]
    for (role, _), run in groupby(range(len(placed)), key=keyed.__getitem__):
        block = _block(role, [placed[i][1] for i in run])
        if block.kind != "paragraph" or block.text:
            out.under_heading(block)
    out.meta["title"] = next((b.text for b in out.roots if b.kind == "heading"), None)
    return out


def with_ocr(lines: DataFrame, decisions: DataFrame, recognised: DataFrame) -> DataFrame:
    """Lines with those of recognised pages in their place: a page that is to be read as an image gives its own lines
    up.  recognised: lines in points, with confidences; a page that recognition gave nothing for keeps what it had."""
    wanted = decisions.where("decision = 'ocr'").select("document_id", "page")
    new = recognised.join(wanted, ["document_id", "page"], "left_semi").select(*lines.columns)
    return lines.join(new.select("document_id", "page").distinct(), ["document_id", "page"], "left_anti").unionByName(new)


def page_meta(decisions: DataFrame, recognised: DataFrame) -> DataFrame:
    """Source and mean confidence of each page: document_id, number, source, confidence."""
    means = recognised.groupBy("document_id", "page").agg(F.avg("confidence").alias("confidence"), F.lit(True).alias("read"))
    ocr = (F.col("decision") == "ocr") & F.coalesce("read", F.lit(False))
    return decisions.join(means, ["document_id", "page"], "left").select("document_id", F.col("page").alias("number"), F.when(ocr, "ocr").otherwise("text_layer").alias("source"), F.when(ocr, F.col("confidence")).alias("confidence"))


def page_warnings(decisions: DataFrame, recognised: DataFrame | None = None) -> DataFrame:
    """document_id, code, page: pages that are blank, that need recognition, were recognised, or gave nothing."""
    rows = decisions.where("decision <> 'text_layer'")
    if recognised is None:
        return rows.select("document_id", F.when(F.col("decision") == "ocr", "page_needs_ocr").otherwise("blank_page").alias("code"), "page")
    read = recognised.select("document_id", "page", F.lit(True).alias("read")).distinct()
    code = F.when(F.col("decision") == "blank_page", "blank_page").when(F.col("read"), "page_ocr_applied").otherwise("ocr_found_no_text")
    return rows.join(read, ["document_id", "page"], "left").select("document_id", code.alias("code"), "page")


def documents(lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Every document of ``lines`` with its blocks, ready for ``serialise.with_text``: document_id, content_hash (of
    the id), blocks, title.  Tables: document_id, page, top, bottom, left, right, rows.

    One task holds the lines of one document at a time.
    """
    free = outside_tables(lines, tables) if tables is not None else lines
    known = paragraphs(free).join(heading_tiers(free), "document_id", "left")
    level = F.when(F.length("text") <= MAX_HEADING, heading_level(F.col("size"), F.col("tiers")))
    rows = known.select("document_id", F.struct("page", "seq", "text", "top", "confidence", "paragraph", level.alias("level")).alias("line"))
    grouped = rows.groupBy("document_id").agg(F.collect_list("line").alias("lines"))
    none = F.array().cast("array<struct<page:int,top:double,rows:array<array<string>>>>")
    if tables is None:
        grouped = grouped.withColumn("tables", none)
    else:
        held = tables.groupBy("document_id").agg(F.collect_list(F.struct("page", "top", "rows")).alias("tables"))
        grouped = grouped.join(held, "document_id", "left").withColumn("tables", F.coalesce("tables", none))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [outline(list(ln), list(tb)) for ln, tb in zip(f["lines"], f["tables"], strict=True)]
            yield pd.DataFrame({"document_id": f["document_id"], "blocks": [o.rows() for o in found], "title": [o.meta["title"] for o in found]})

    kind = dict(lines.dtypes)["document_id"]
    parsed = grouped.mapInPandas(run, f"document_id {kind}, blocks array<{BLOCK}>, title string")
    return parsed.withColumn("content_hash", F.sha2(F.col("document_id").cast("string"), 256))


def structure(lines: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Block rows of every document: document_id, ordinal, parent, type, depth, page, raw, confidence."""
    rows = documents(lines, tables).select("document_id", F.explode("blocks").alias("b"))
    return rows.select("document_id", *(F.col(f"b.{c}").alias(c) for c in ("ordinal", "parent", "type", "depth", "page", "raw", "confidence")))
