"""Streaming ingest: messages to parsed documents, a batch at a time.

A batch registers and claims its documents, fetches, parses, writes artifacts, then commits both control tables at once
and writes its messages.  The checkpoint advances last, and a batch that comes again finds itself committed, so every
effect happens once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.errors import is_transient
from quillmark.functions.text import options_hash
from quillmark.operators.parsers import VERSION
from quillmark.plans.documents import build, read_artifacts, write_artifacts
from quillmark.sources.jobs import TOPIC_COMPLETED, TOPIC_REQUESTED, dead_letters, due, jobs, retry_delay, retry_topic, route
from quillmark.streaming.lifecycle import ControlStore, claim, complete_runs, fail_runs, first_claims, register, start_runs

#: From jobs to blobs: adds content (null if there is none) and failure_class.
Fetcher = Callable[[DataFrame], DataFrame]


def table_fetcher(blobs: DataFrame) -> Fetcher:
    """Contents from a table of (reference, content); a reference without a row is not found."""

    def fetch(asked: DataFrame) -> DataFrame:
        return asked.join(blobs.select("reference", "content"), "reference", "left").withColumn("failure_class", F.when(F.col("content").isNull(), "not_found"))

    return fetch


class Ingest:
    def __init__(self, spark: SparkSession, folder: str, fetch: Fetcher, parser_version: str = VERSION):
        self.spark, self.folder, self.fetch, self.version = spark, folder.rstrip("/"), fetch, parser_version
        self.store = ControlStore(spark, f"{self.folder}/control")

    def _kept(self, df: DataFrame, label: str, batch: int) -> DataFrame:
        path = f"{self.folder}/work/{batch}/{label}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def process(self, messages: DataFrame, batch: int) -> None:
        if self.store.pointer()["batch"] is not None and batch <= self.store.pointer()["batch"]:
            return
        now = F.lit(self.spark.sql("SELECT current_timestamp() AS t").first()["t"])
        parsed = self._kept(jobs(messages), "messages", batch)
        waiting = parsed.where("error IS NULL")
        ready = due(waiting, now)
        late = waiting.join(ready.select("partition", "offset", "topic"), ["partition", "offset", "topic"], "left_anti")
        work = ready.select("offset", "job.*").withColumn("parse_options_hash", options_hash("parse_options"))
        documents, runs = self.store.read()
        documents = register(documents, work, now)
        mine = first_claims(work)
        documents, outcome = claim(documents, mine, now)
        claimed = mine.join(outcome.where("claimed").select(F.col("id").alias("document_id")), "document_id")
        fetched = self._kept(self.fetch(claimed).withColumn("content_hash", F.sha2("content", 256)), "fetched", batch)
        runs, started = start_runs(runs, fetched.where("failure_class IS NULL").withColumn("parser_version", F.lit(self.version)), now)
        started = self._kept(started, "started", batch)
        todo = fetched.join(started.select("document_id", F.col("id").alias("run_id")), "document_id")
        raw = todo.select("document_id", "filename", F.col("media_type").alias("declared_media_type"), "content")
        result = build(raw)
        write_artifacts(result, f"{self.folder}/artifacts")
        stored = read_artifacts(self.spark, f"{self.folder}/artifacts").artifacts.select("document_id", "content_hash", "parser_version")
        done = stored.where(F.col("parser_version") == VERSION).join(todo.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_semi").select("document_id", "content_hash")
        key = F.concat(F.lit("parsed/"), F.col("content_hash"), F.lit(f"/{VERSION}/document.json"))
        complete = self._kept(done.join(started.select("document_id", "id"), "document_id").select("id", "document_id", key.alias("artifact_key"), "content_hash"), "complete", batch)
        lost = todo.select("document_id", "run_id").join(result.failures, "document_id")
        never = fetched.where("failure_class IS NOT NULL").select("document_id", F.lit(None).cast("string").alias("run_id"), "failure_class", F.lit("could not be fetched").alias("failure_reason"))
        failed = lost.select("document_id", "run_id", "failure_class", "failure_reason").unionByName(never).join(claimed.select("document_id", "attempt"), "document_id")
        transient = is_transient(F.col("failure_class"))
        failed = self._kept(failed.withColumn("to", route(F.col("failure_class"), F.col("attempt"), transient)).withColumn("final", ~transient | retry_topic(F.col("attempt")).isNull()), "failed", batch)
        documents, runs = complete_runs(documents, runs, complete, now)
        documents, runs = fail_runs(documents, runs, failed, now)
        # a document whose run another batch already finished is ready again as it was
        outbox = self._messages(parsed, late, claimed, complete, failed, now)
        outbox.write.mode("overwrite").partitionBy("topic").parquet(f"{self.folder}/outbox/batch={batch}")
        self.store.commit(documents, runs, batch)

    def _messages(self, parsed: DataFrame, late: DataFrame, claimed: DataFrame, complete: DataFrame, failed: DataFrame, now) -> DataFrame:
        """Completed documents, retries, jobs that were not due, and dead letters."""
        body = lambda: F.to_json(F.struct(*(c for c in claimed.columns if c not in ("offset", "parse_options_hash")))).cast("binary")
        no_headers = F.create_map().cast("map<string,string>")
        ready = claimed.join(complete.select("document_id"), "document_id").select(F.lit(TOPIC_COMPLETED).alias("topic"), F.col("document_id").alias("key"), body().alias("value"), no_headers.alias("headers"))
        again = failed.select("document_id", "failure_class", "failure_reason", "to")
        next_job = claimed.drop("not_before").join(again, "document_id").withColumn("not_before", now + F.make_dt_interval(secs=F.coalesce(retry_delay(F.col("attempt")), F.lit(0)).cast("decimal(18,6)"))).withColumn("attempt", F.col("attempt") + F.when(F.col("to.delay_seconds").isNotNull(), 1).otherwise(0))
        headers = F.create_map(F.lit("failure_class"), F.col("to.failure_class"), F.lit("failure_reason"), F.coalesce("failure_reason", F.lit("")))
        retries = next_job.select(F.col("to.topic").alias("topic"), F.col("document_id").alias("key"), body().alias("value"), headers.alias("headers"))
        held = late.select(F.coalesce("topic", F.lit(TOPIC_REQUESTED)).alias("topic"), F.col("job.document_id").alias("key"), "value", no_headers.alias("headers"))
        return ready.unionByName(retries).unionByName(held).unionByName(dead_letters(parsed))

    def start(self, stream: DataFrame, once: bool = False):
        """Run on a stream of messages; once: what is there now, then stop."""
        writer = stream.writeStream.foreachBatch(lambda df, batch: self.process(df, batch)).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer).start()
