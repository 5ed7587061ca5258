"""Raw documents to the tables that everything else reads: artifacts, blocks, pages and metrics."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import word_count
from quillmark.operators.parse import parse
from quillmark.operators.parsers import VERSION
from quillmark.operators.parsers.image import Reader
from quillmark.operators.serialise import block_table, page_table, with_text
from quillmark.plans.store import kept

SCHEMA_VERSION = "1.0"


@dataclass
class Parsed:
    """artifacts: one row for each document that parsed; failures: the others."""

    artifacts: DataFrame
    blocks: DataFrame
    pages: DataFrame
    failures: DataFrame


def counts(text: Column, blocks: Column) -> dict[str, Column]:
    """Counts that describe the canonical text, as longs."""
    of = lambda kind: F.size(F.filter(blocks, lambda b: b["type"] == kind)).cast("long")
    return {"char_count": F.length(text).cast("long"), "word_count": word_count(text), "block_count": F.size(blocks).cast("long"), "heading_count": of("heading"), "table_count": of("table")}


def metadata(parsed: DataFrame) -> DataFrame:
    """Puts the counts into the metadata; a parser's own page count stays, else it is the number of known pages."""
    m, pages = F.col("metadata"), F.array_distinct(F.filter(F.transform("blocks", lambda b: b["page"]), lambda p: p.isNotNull()))
    for name, c in counts(F.col("text"), F.col("blocks")).items():
        m = m.withField(name, c)
    return parsed.withColumn("metadata", m.withField("page_count", F.coalesce(F.col("metadata.page_count"), F.when(F.size(pages) > 0, F.size(pages)))))


def build(raw: DataFrame, ocr: Reader | None = None, ids: bool = True) -> Parsed:
    """All tables of raw_docs.  Nothing here depends on a clock, so the same bytes give the same artifact."""
    every = parse(raw, ocr)
    good = metadata(with_text(every.where("failure IS NULL"))).withColumn("schema_version", F.lit(SCHEMA_VERSION)).withColumn("parser_version", F.lit(VERSION))
    blocks = block_table(good, ids)
    meta = good.select("document_id", F.explode("page_meta").alias("p")).select("document_id", "p.*")
    failures = every.where("failure IS NOT NULL").select("document_id", "content_hash", "media_type", F.col("failure").alias("failure_class"), F.col("reason").alias("failure_reason"))
    return Parsed(good, blocks, page_table(blocks, meta), failures)


def metrics(artifacts: DataFrame) -> DataFrame:
    """What a success is worth telling: sizes, characters a page (null without pages) and the warnings' codes."""
    m = F.col("metadata")
    return artifacts.select(
        "document_id", m["format"].alias("format"), m["char_count"].alias("chars"), m["block_count"].alias("blocks"), m["page_count"].alias("pages"), m["ocr_page_count"].alias("ocr_pages"),
        F.when(m["page_count"] > 0, m["char_count"] / m["page_count"]).alias("chars_per_page"), F.transform("warnings", lambda w: w["code"]).alias("warnings"),
    )


def warnings_histogram(artifacts: DataFrame) -> DataFrame:
    return artifacts.select(F.explode("warnings").alias("w")).groupBy(F.col("w.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


#: An artifact is what one parser version makes of one document's content.
KEY = ("document_id", "content_hash", "parser_version")
TABLES = ("blocks", "pages", "artifacts")


def artifact_key() -> Column:
    return F.concat(F.lit("parsed/"), F.col("content_hash"), F.lit("/"), F.col("parser_version"), F.lit("/document.json"))


def _stored(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of the folder, or None before its first write; batches share one schema."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.option("mergeSchema", "false").parquet(f"{folder}/{name}")


def write_artifacts(parsed: Parsed, folder: str) -> None:
    """Append artifacts, blocks and pages that the folder does not hold yet; what is there is never touched.

    Every write is a batch of its own, and blocks and pages count only if an artifact of their batch points at them, so
    a write that was cut off leaves nothing that anyone reads, and writing the same documents again changes nothing.
    """
    spark = parsed.artifacts.sparkSession
    held = _stored(spark, folder, "artifacts")
    fresh = parsed.artifacts.dropDuplicates(list(KEY))
    if held is not None:
        mine = [F.col(f"a.{c}").eqNullSafe(F.col(f"h.{c}")) for c in KEY]
        fresh = fresh.alias("a").join(read_artifacts(spark, folder).artifacts.select(*KEY).alias("h"), mine, "left_anti")
    batch = uuid.uuid4().hex
    keys = kept(fresh.select("document_id").distinct(), "fresh-artifacts")
    fresh = fresh.join(keys, "document_id", "left_semi") if held is None else fresh
    for name, df in (("blocks", parsed.blocks), ("pages", parsed.pages)):
        df.join(keys, "document_id", "left_semi").withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/{name}")
    fresh.withColumn("artifact_key", artifact_key()).withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/artifacts")


def read_artifacts(spark: SparkSession, folder: str, keys: DataFrame | None = None) -> Parsed:
    """The stored tables, of all artifacts or of those of an artifact_key in ``keys``; deleted ones are left out."""
    artifacts = _stored(spark, folder, "artifacts")
    if artifacts is None:
        raise FileNotFoundError(f"{folder} holds no artifacts")
    gone = _stored(spark, folder, "deleted")
    if gone is not None:
        artifacts = artifacts.join(gone.select("artifact_key", "batch").distinct(), ["artifact_key", "batch"], "left_anti")
    if keys is not None:
        artifacts = artifacts.join(keys.select("artifact_key").distinct(), "artifact_key", "left_semi")
    own = artifacts.select("document_id", "batch").distinct()
    blocks, pages = (_stored(spark, folder, x).join(own, ["document_id", "batch"], "left_semi").drop("batch") for x in TABLES[:2])
    return Parsed(artifacts.drop("batch"), blocks, pages, artifacts.where("false").select("document_id", "content_hash", "media_type", F.lit("").alias("failure_class"), F.lit("").alias("failure_reason")))


def artifact_exists(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """artifact_key and stored, for every key asked for."""
    asked = keys.select("artifact_key").distinct()
    held = read_artifacts(spark, folder, asked).artifacts.select("artifact_key").distinct().withColumn("stored", F.lit(True))
    return asked.join(held, "artifact_key", "left").select("artifact_key", F.coalesce("stored", F.lit(False)).alias("stored"))


def delete_artifacts(spark: SparkSession, folder: str, keys: DataFrame) -> None:
    """Mark artifacts as deleted; a later write of the same document stores it anew."""
    held = _stored(spark, folder, "artifacts").select("artifact_key", "batch")
    held.join(keys.select("artifact_key").distinct(), "artifact_key", "left_semi").distinct().write.mode("append").parquet(f"{folder}/deleted")
