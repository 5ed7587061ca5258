"""Blobs from storage: binary files below allowed roots, sizes checked before contents are read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.parse import MAX_BYTES
from quillmark.sources.jobs import MESSAGE

RAW = "document_id string, tenant_id string, project_id string, filename string, declared_media_type string, content binary, source_uri string"


class RefusedPath(ValueError):
    pass


def allowed(path: str, roots: tuple[str, ...]) -> str:
    """The resolved path, if it lies below one of the roots.  Without roots no local file may be read."""
    scheme, _, local = path.rpartition("://")
    if scheme not in ("", "file"):
        return path
    real = os.path.realpath(local or path)
    if not any(os.path.commonpath([real, os.path.realpath(r)]) == os.path.realpath(r) for r in roots):
        raise RefusedPath(f"{path} is not below an allowed root")
    return real


def read_blobs(spark: SparkSession, path: str, roots: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """raw_docs of the files at a path.  The size filter reaches the scan, so no oversized file is read."""
    files = spark.read.format("binaryFile").load(allowed(path, roots)).where((F.col("length") > 0) & (F.col("length") <= max_bytes))
    name = F.element_at(F.split("path", "/"), -1)
    none = F.lit(None).cast("string")
    return files.select(F.sha2("path", 256).alias("document_id"), none.alias("tenant_id"), none.alias("project_id"), name.alias("filename"), none.alias("declared_media_type"), "content", F.col("path").alias("source_uri"))


def refused_blobs(spark: SparkSession, path: str, roots: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files that are too large, with their failure class; contents are not read.  (Spark's scan lists no empty file.)"""
    files = spark.read.format("binaryFile").load(allowed(path, roots)).where(F.col("length") > max_bytes)
    return files.select(F.sha2("path", 256).alias("document_id"), F.col("path").alias("source_uri"), "length", F.lit("too_large").alias("failure"))


def text_documents(spark: SparkSession, path: str, id_column: str, text_column: str, extension: str) -> DataFrame:
    """raw_docs of a Parquet table of texts."""
    rows = spark.read.parquet(path)
    none = F.lit(None).cast("string")
    return rows.select(F.col(id_column).cast("string").alias("document_id"), none.alias("tenant_id"), none.alias("project_id"), F.concat(F.col(id_column).cast("string"), F.lit(f".{extension}")).alias("filename"), none.alias("declared_media_type"), F.encode(text_column, "UTF-8").alias("content"), none.alias("source_uri"))


def message_stream(spark: SparkSession, path: str | None = None, servers: str | None = None, topics: tuple[str, ...] = (), per_trigger: int = 100) -> DataFrame:
    """A stream of messages in Kafka's columns: from a broker, or from Parquet files that hold them."""
    if servers:
        stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").option("includeHeaders", "true").option("maxOffsetsPerTrigger", per_trigger).load()
        return stream.withColumn("key", F.col("key").cast("string"))
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", per_trigger).parquet(path)
