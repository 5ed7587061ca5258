"""Command line: ``python -m quillmark check | document PATH | locate PATH QUOTE... | consume INBOX FOLDER BLOBS``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.config import ConfigError, Settings
from quillmark.operators.locate import locate
from quillmark.plans.documents import Parsed, build
from quillmark.sources.files import message_stream, read_blobs
from quillmark.streaming.ingest import Ingest, table_fetcher


def preflight(settings: Settings) -> dict[str, str]:
    """What a run would miss: one line for each part, 'ok' or what is wrong."""
    out = {}
    try:
        settings.require_storage()
        out["storage"] = "ok"
    except ConfigError as e:
        out["storage"] = str(e)
    out["local_roots"] = next((f"{r} is no folder" for r in settings.local_roots if not os.path.isdir(r)), "ok")
    out["queue"] = "ok" if settings.kafka_bootstrap_servers else "KAFKA_BOOTSTRAP_SERVERS is not set"
    return out


def outline(parsed: Parsed) -> DataFrame:
    """Blocks as an indented list."""
    shown = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("depth") - 1, F.lit(0))), F.substring(F.regexp_replace("own", "\n", " "), 1, 70))
    return parsed.blocks.orderBy("document_id", "ordinal").select("ordinal", "type", "span_start", "span_end", shown.alias("text"))


def summary(parsed: Parsed) -> DataFrame:
    return parsed.artifacts.select("document_id", "media_type", "metadata.title", "metadata.char_count", "metadata.block_count", F.transform("warnings", lambda w: w["code"]).alias("warnings"))


def located(parsed: Parsed, quotes: list[str]) -> DataFrame:
    asked = parsed.artifacts.select("document_id", F.posexplode(F.array(*map(F.lit, quotes))).alias("quote_idx", "quote"))
    return locate(asked, parsed.artifacts.select("document_id", "text"), parsed.blocks, parsed.pages).select("quote", "match", "span_start", "span_end", "similarity", "reason")


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="quillmark", description=__doc__)
    modes = parser.add_subparsers(dest="mode", required=True)
    modes.add_parser("check")
    modes.add_parser("document").add_argument("path")
    found = modes.add_parser("locate")
    found.add_argument("path")
    found.add_argument("quote", nargs="+")
    consume = modes.add_parser("consume")
    for name in ("inbox", "folder", "blobs"):
        consume.add_argument(name)
    given = parser.parse_args(args)
    settings = Settings.from_env()
    if given.mode == "check":
        print(json.dumps({"settings": settings.describe(), "checks": (checks := preflight(settings))}, default=str))
        return int(any(x != "ok" for x in checks.values()))
    spark = SparkSession.builder.appName("quillmark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.mode == "consume":
        blobs = spark.read.parquet(given.blobs)
        Ingest(spark, given.folder, table_fetcher(blobs), settings.parser_version).start(message_stream(spark, given.inbox), once=True).awaitTermination()
        return 0
    parsed = build(read_blobs(spark, given.path, settings.local_roots or (os.path.dirname(os.path.abspath(given.path)),), settings.max_fetch_bytes))
    parsed.failures.show(truncate=False)
    if given.mode == "document":
        summary(parsed).show(truncate=False)
        outline(parsed).show(200, truncate=False)
    else:
        located(parsed, given.quote).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
