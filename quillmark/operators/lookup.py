"""Questions about offsets: which block, which page, which section.  All joins carry the document's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.plans.store import kept



def _best(offsets: DataFrame, spans: DataFrame, best: Column, out: Column) -> DataFrame:
    """Each row of ``offsets`` with the best span that covers its offset; equal rows are looked up once and all answered."""
    asked = offsets.groupBy(*offsets.columns).agg(F.count(F.lit(1)).alias("_times")).withColumn("ask", F.struct(*offsets.columns, "_times"))
    covers = (F.col("document_id") == F.col("in_document")) & (F.col("span_start") <= F.col("offset")) & (F.col("offset") < F.col("span_end"))
    found = asked.join(spans, covers, "left").groupBy("ask").agg(best.alias("best"))
    every = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("ask._times"))))
    return every.select(*(F.col(f"ask.`{c}`") for c in offsets.columns), out)


def block_at(offsets: DataFrame, blocks: DataFrame) -> DataFrame:
    """The narrowest block that covers each offset, the later one of equals; null where none does.

    offsets: document_id, offset and any other columns.  Each offset keeps its own row, repeated ones too.
    """
    b = blocks.select(F.col("document_id").alias("in_document"), "ordinal", "span_start", "span_end")
    narrow = F.struct((F.col("span_start") - F.col("span_end")).alias("narrow"), F.col("ordinal"))
    return _best(offsets, b, F.max(F.when(F.col("ordinal").isNotNull(), narrow)), F.col("best.ordinal").alias("block_ordinal"))


def page_at(offsets: DataFrame, pages: DataFrame) -> DataFrame:
    """The lowest page that covers each offset, or null; each offset keeps its own row."""
    p = pages.select(F.col("document_id").alias("in_document"), "number", "span_start", "span_end")
    return _best(offsets, p, F.min("number"), F.col("best").alias("page"))


def heading_path(blocks: DataFrame) -> DataFrame:
    """document_id, ordinal and path: the headings above each block, itself included, outermost first.

    blocks: document_id, ordinal, parent, type, own.  Every round joins each block with the one its pointer shows and
    takes over that one's pointer, so a depth of d takes log2(d) rounds, however many blocks there are.
    """
    title = F.regexp_replace("own", "^[# ]+", "")
    own = F.when(F.col("type") == "heading", F.array(title)).otherwise(F.array().cast("array<string>"))
    at = blocks.select("document_id", "ordinal", F.col("parent").alias("up"), own.alias("path"))
    while not at.where("up IS NOT NULL").isEmpty():
        above = at.select("document_id", F.col("ordinal").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        met = at.join(above, ["document_id", "up"], "left")
        at = kept(met.select("document_id", "ordinal", F.col("next").alias("up"), F.concat(F.coalesce("above", F.array().cast("array<string>")), "path").alias("path")), "heading-path")
    return at.select("document_id", "ordinal", "path")


def table_shape(blocks: DataFrame) -> DataFrame:
    """Rows and widest row of each table."""
    tables = blocks.where("table IS NOT NULL")
    return tables.select("document_id", "ordinal", F.size("table.rows").alias("n_rows"), F.coalesce(F.array_max(F.transform("table.rows", F.size)), F.lit(0)).alias("n_columns"))


