"""Bytes to blocks: one Arrow pass that gives each document its blocks in document order, or an error."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.errors import ParseFailure
from quillmark.operators import parsers
from quillmark.operators.detect import detect, mismatch_warning
from quillmark.operators.parsers.image import Reader

BLOCK = "struct<ordinal:int,parent:int,last:int,type:string,depth:int,page:int,raw:string,rows:array<array<string>>,header_rows:int,confidence:double,ordered:boolean,number:int,lang:string,first:boolean>"
META = "struct<format:string,title:string,author:string,subject:string,keywords:array<string>,language:string,page_count:int,created_at:string,modified_at:string,producer:string,has_text_layer:boolean,ocr_applied:boolean,ocr_page_count:int>"
WARNING = "struct<code:string,message:string,page:int,block_id:string>"
PAGE = "struct<number:int,source:string,confidence:double>"
PARSED = f"document_id string, content_hash string, media_type string, parser string, blocks array<{BLOCK}>, metadata {META}, page_meta array<{PAGE}>, warnings array<{WARNING}>, failure string, reason string"
FIELDS = [x.partition(":")[0] for x in "format title author subject keywords language page_count created_at modified_at producer has_text_layer ocr_applied ocr_page_count".split()]
MAX_BYTES = 100 * 1024 * 1024


def blank(document_id: str, content_hash: str, media_type: str) -> dict:
    return {"document_id": document_id, "content_hash": content_hash, "media_type": media_type, "parser": None, "blocks": None, "metadata": None, "page_meta": None, "warnings": [], "failure": None, "reason": None}


def parse_one(document_id: str, content_hash: str, media_type: str, content: bytes, known: dict) -> dict:
    row = blank(document_id, content_hash, media_type)
    try:
        name, out = parsers.parse(content, media_type, known)
    except ParseFailure as e:
        return row | {"failure": e.failure, "reason": e.reason}
    except Exception as e:  # a parser's crash must not end the job; nobody knows whether it would pass
        return row | {"failure": "internal", "reason": f"{type(e).__name__}: {e}"}
    return row | {
        "parser": name,
        "blocks": out.rows(),
        "metadata": {k: out.meta.get(k) for k in FIELDS},
        "page_meta": [{"number": n, "source": s, "confidence": c} for n, (s, c) in sorted(out.pages.items())],
        "warnings": [{"code": c, "message": m, "page": p, "block_id": None} for c, m, p in out.warnings],
    }


def sized(raw: DataFrame) -> DataFrame:
    """Adds content_hash and the failure of blobs that are missing, empty or too large; they are never parsed."""
    size = F.octet_length("content")
    failure = F.when(size.isNull() | (size == 0), "not_found").when(size > MAX_BYTES, "too_large")
    return raw.withColumn("content_hash", F.sha2("content", 256)).withColumn("size_failure", failure)


def _rows(found: DataFrame, ocr: Reader | None) -> DataFrame:
    """Each row of (document_id, content_hash, media_type, size_failure, content) parsed where it stands."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = parsers.registry(ocr)
        for f in frames:
            out = []
            for d, h, m, bad, c in zip(f["document_id"], f["content_hash"], f["media_type"], f["size_failure"], f["content"], strict=True):
                out.append(parse_one(d, h, m, bytes(c), known) if bad is None else blank(d, h, m) | {"failure": bad, "reason": bad})
            yield pd.DataFrame(out, columns=[x.split()[0] for x in PARSED.split(", ")])

    content = F.when(F.col("size_failure").isNull(), F.col("content"))
    return found.select("document_id", "content_hash", "media_type", "size_failure", content.alias("content")).mapInPandas(run, PARSED)


def parse(raw: DataFrame, ocr: Reader | None = None, once: bool = False) -> DataFrame:
    """Parsed documents of raw_docs (document_id, filename, declared_media_type, content).

    Rows are parsed where they stand, without a shuffle; parsing is deterministic, so equal contents give equal results.
    once: equal contents of a type are parsed once and joined back, which pays where parsing costs more than moving
    the bytes (images).
    """
    declared = F.col("declared_media_type").cast("string") if "declared_media_type" in raw.columns else F.lit(None).cast("string")
    found = sized(raw).withColumn("media_type", detect(F.col("content"), F.col("filename")))
    none = F.array().cast(f"array<{WARNING}>")
    if once:
        keys = found.select("document_id", "content_hash", "media_type", "size_failure", declared.alias("declared"))
        distinct = found.where("size_failure IS NULL").groupBy("content_hash", "media_type").agg(F.first("content").alias("content"))
        done = _rows(distinct.select(F.col("content_hash").alias("document_id"), "content_hash", "media_type", F.lit(None).cast("string").alias("size_failure"), "content"), ocr)
        joined = keys.join(done.drop("document_id"), ["content_hash", "media_type"], "left")
        joined = joined.withColumn("failure", F.coalesce("size_failure", "failure")).withColumn("reason", F.coalesce("reason", "size_failure"))
    else:  # the declared type rides along with the id
        tagged = found.withColumn("document_id", F.to_json(F.struct(F.col("document_id").cast("string").alias("d"), declared.alias("m"))))
        tag = F.from_json("document_id", "d string, m string")
        joined = _rows(tagged, ocr).withColumn("tag", tag).withColumn("document_id", F.col("tag.d")).withColumn("declared", F.col("tag.m"))
    warned = mismatch_warning(F.col("declared"), F.col("media_type"))
    warnings = F.concat(F.when(warned.isNotNull(), F.array(warned)).otherwise(none), F.coalesce("warnings", none))
    return joined.select("document_id", "content_hash", "media_type", "parser", "blocks", "metadata", "page_meta", warnings.alias("warnings"), "failure", "reason")
