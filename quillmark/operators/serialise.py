"""Blocks to canonical text and exact spans, in column expressions.

A block's own text and the separator before it follow from the block and its parent; the text of a document is their
concatenation, and spans are running sums of lengths in code points, taken within the document's row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quillmark.functions.text import ANY_SPACE, block_id, render_table

LISTS = ("list", "list_item")


def _rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{ANY_SPACE}+$", "")


def own_text(b: Column) -> Column:
    """What a block writes itself, without its children."""
    hashes = F.repeat(F.lit("#"), F.least(F.greatest(b["depth"], F.lit(1)), F.lit(6)))
    indent = F.repeat(F.lit("  "), F.greatest(b["depth"] - 1, F.lit(0)))
    marker = F.when(F.coalesce(b["ordered"], F.lit(False)), F.concat(F.coalesce(b["number"], F.lit(1)).cast("string"), F.lit(". "))).otherwise("- ")
    return (
        F.when(b["type"] == "list", "")
        .when(b["type"] == "heading", _rstrip(F.concat(hashes, F.lit(" "), b["raw"])))
        .when(b["type"] == "list_item", _rstrip(F.concat(indent, marker, b["raw"])))
        .when(b["type"] == "code", F.concat(F.lit("```"), F.coalesce(b["lang"], F.lit("")), F.lit("\n"), b["raw"], F.lit("\n```")))
        .when(b["type"] == "table", render_table(b["rows"], b["header_rows"]))
        .otherwise(b["raw"])
    )


def separator(b: Column, parent_type: Column, parent_own: Column) -> Column:
    """What stands before a block: nothing first of all, and nothing below a parent that wrote nothing."""
    between = F.when(parent_type.isin(*LISTS), "\n").otherwise("\n\n")
    return F.when(b["ordinal"] == 0, "").when(b["parent"].isNotNull() & b["first"] & (parent_own == ""), "").otherwise(between)


def with_text(parsed: DataFrame) -> DataFrame:
    """Adds the canonical text, and gives each block its own text and separator."""
    owned = F.transform("blocks", lambda b: b.withField("own", own_text(b)))
    df = parsed.withColumn("blocks", owned)

    def placed(b: Column) -> Column:
        parent = F.get(F.col("blocks"), b["parent"])
        return b.withField("sep", separator(b, parent["type"], parent["own"]))

    df = df.withColumn("blocks", F.transform("blocks", placed))
    return df.withColumn("text", F.array_join(F.transform("blocks", lambda b: F.concat(b["sep"], b["own"])), ""))


@F.pandas_udf(StructType([StructField(x, ArrayType(IntegerType())) for x in ("start", "end", "own_end")]))
def _spans(sep: pd.Series, own: pd.Series, last: pd.Series) -> pd.DataFrame:
    """Spans of each document's blocks from the lengths of their separators and own texts.

    last: the last descendant whose end a block's span covers (itself, unless it is a container); document order gives
    that one the greatest end of the subtree.
    """
    out = []
    for s, o, j in zip(sep, own, last, strict=True):
        s, o = np.asarray(s, np.int64), np.asarray(o, np.int64)
        ends = np.cumsum(s + o)
        out.append(((ends - o).tolist(), ends[np.asarray(j, np.int64)].tolist() if len(ends) else [], ends.tolist()))
    return pd.DataFrame(out, columns=["start", "end", "own_end"])


def block_table(texts: DataFrame, ids: bool = True) -> DataFrame:
    """One row for each block: its span in the text (a list or item covers its descendants) and its own text.

    Spans are found within the document's row, from lengths alone, so no text is shuffled.
    """
    of = lambda f: F.transform("blocks", f)
    cover = lambda b: F.when(b["type"].isin(*LISTS), b["last"]).otherwise(b["ordinal"])
    # (asNondeterministic: the optimizer must not move the call across the explode)
    spans = _spans.asNondeterministic()(of(lambda b: F.length(b["sep"])), of(lambda b: F.length(b["own"])), of(cover))
    rows = texts.select("document_id", "content_hash", "blocks", spans.alias("spans")).select("document_id", "content_hash", "spans", F.posexplode("blocks").alias("at", "b"))
    at = lambda name: F.get(F.col(f"spans.{name}"), F.col("at"))
    rows = rows.select("document_id", "content_hash", "b.*", at("start").alias("span_start"), at("end").alias("span_end"), at("own_end").alias("own_end"))
    rows = rows.withColumn("table", F.when(F.col("rows").isNotNull(), F.struct("rows", "header_rows"))).withColumn("attrs", F.struct("ordered", "number", "lang"))
    if ids:
        rows = rows.withColumn("id", block_id("content_hash", "ordinal")).withColumn("parent_id", F.when(F.col("parent").isNotNull(), block_id("content_hash", F.coalesce("parent", F.lit(0)))))
    return rows.drop("rows", "header_rows", "ordered", "number", "lang", "sep", "first")


def page_table(blocks: DataFrame, page_meta: DataFrame | None = None) -> DataFrame:
    """Pages by the blocks on them: span, characters, source and confidence (a text layer where nothing is known).

    page_meta: document_id, number, source, confidence.
    """
    shown = blocks.where("page IS NOT NULL AND span_end > span_start")
    pages = shown.groupBy("document_id", F.col("page").alias("number")).agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"))
    pages = pages.withColumn("char_count", F.col("span_end") - F.col("span_start"))
    if page_meta is None:
        return pages.withColumn("source", F.lit("text_layer")).withColumn("confidence", F.lit(None).cast("double"))
    return pages.join(page_meta, ["document_id", "number"], "left").withColumn("source", F.coalesce("source", F.lit("text_layer")))
