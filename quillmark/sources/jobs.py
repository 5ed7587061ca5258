"""Messages to jobs: upload events and replayed jobs from one stream of Kafka's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import strip

#: Topics, retry tiers (seconds), required fields in the order that an error names them.
TOPIC_REQUESTED, TOPIC_COMPLETED, TOPIC_DLQ = "documents.parse.requested", "documents.parse.completed", "documents.parse.dlq"
RETRY_DELAYS = (30, 300, 1800)
RETRY_TOPICS = ("documents.parse.retry.30s", "documents.parse.retry.5m", "documents.parse.retry.30m")
REQUIRED = ("document_id", "s3_bucket", "s3_key", "tenant_id")
PAYLOAD = "struct<document_id:string,reference:string,tenant_id:string,project_id:string,media_type:string,filename:string,size:string,event_id:string,trace_id:string,attempt:int,not_before:timestamp,parse_options:string,force:boolean,s3_bucket:string,s3_key:string,content_type:string>"
MESSAGE = "key string, value binary, headers array<struct<key:string,value:binary>>, topic string, partition int, offset long, timestamp timestamp"


def _given(c: Column) -> Column:
    text = strip(c)
    return F.when(text != "", text)


def missing_fields(p: Column) -> Column:
    """Names of the required fields that an event lacks or leaves blank."""
    return F.filter(F.array(*(F.when(_given(p[k]).isNull(), k) for k in REQUIRED)), lambda x: x.isNotNull())


def event_job(p: Column) -> Column:
    """The job of an upload event."""
    key = F.regexp_replace(strip(p["s3_key"]), "^/+", "")
    event = _given(p["event_id"])
    return F.struct(
        strip(p["document_id"]).alias("document_id"), F.concat(F.lit("s3://"), strip(p["s3_bucket"]), F.lit("/"), key).alias("reference"), _given(p["tenant_id"]).alias("tenant_id"), _given(p["project_id"]).alias("project_id"),
        _given(p["content_type"]).alias("media_type"), F.coalesce(_given(p["filename"]), F.substring_index(key, "/", -1)).alias("filename"), F.when(F.regexp_like(p["size"], F.lit("^[0-9]+$")), p["size"].cast("long")).alias("size"),
        event.alias("event_id"), F.coalesce(_given(p["trace_id"]), event).alias("trace_id"), F.lit(1).alias("attempt"), F.lit(None).cast("timestamp").alias("not_before"), F.lit("{}").alias("parse_options"), F.lit(False).alias("force"),
    )


def replayed_job(p: Column) -> Column:
    """A job that was written by a retry or a replay."""
    return F.struct(
        p["document_id"].alias("document_id"), p["reference"].alias("reference"), p["tenant_id"].alias("tenant_id"), p["project_id"].alias("project_id"), p["media_type"].alias("media_type"), p["filename"].alias("filename"), p["size"].cast("long").alias("size"),
        p["event_id"].alias("event_id"), p["trace_id"].alias("trace_id"), F.coalesce(p["attempt"], F.lit(1)).alias("attempt"), p["not_before"].alias("not_before"), F.coalesce(p["parse_options"], F.lit("{}")).alias("parse_options"), F.coalesce(p["force"], F.lit(False)).alias("force"),
    )


def jobs(messages: DataFrame) -> DataFrame:
    """Adds job (null if malformed) and error to messages.  A message with a reference is a job, any other an event."""
    p = F.from_json(F.col("value").cast("string"), PAYLOAD, {"mode": "PERMISSIVE"})
    df = messages.withColumn("payload", p)
    broken = F.col("payload").isNull() | ~F.coalesce(F.regexp_like(strip(F.col("value").cast("string")), F.lit(r"(?s)^\{.*\}$")), F.lit(False))
    missing = missing_fields(F.col("payload"))
    is_job = F.col("payload.reference").isNotNull()
    error = F.when(broken, "message is not a JSON object").when(~is_job & (F.size(missing) > 0), F.concat(F.lit("event is missing required field(s): "), F.array_join(missing, ", "))).when(is_job & F.col("payload.document_id").isNull(), "job has no document_id")
    df = df.withColumn("error", error)
    return df.withColumn("job", F.when(F.col("error").isNull(), F.when(is_job, replayed_job(F.col("payload"))).otherwise(event_job(F.col("payload"))))).drop("payload")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Outbox rows of messages that are no jobs: the bytes as they came, and why."""
    bad = parsed.where("error IS NOT NULL")
    headers = F.create_map(F.lit("failure_class"), F.lit("malformed_event"), F.lit("failure_reason"), F.col("error"), F.lit("source_topic"), F.col("topic"))
    return bad.select(F.lit(TOPIC_DLQ).alias("topic"), F.coalesce("key", F.lit("unknown")).alias("key"), "value", headers.alias("headers"))


def retry_topic(attempt: Column) -> Column:
    """Where attempt n of a job goes when it fails for a passing reason; null once the tiers are used up."""
    return F.get(F.array(*map(F.lit, RETRY_TOPICS)), attempt - 1)


def retry_delay(attempt: Column) -> Column:
    return F.get(F.array(*map(F.lit, RETRY_DELAYS)), attempt - 1)


def route(failure: Column, attempt: Column, transient: Column) -> Column:
    """Topic and failure class of a failed job: a retry tier, or the dead-letter topic."""
    tier = retry_topic(attempt)
    exhausted = transient & tier.isNull()
    return F.struct(F.when(transient & tier.isNotNull(), tier).otherwise(TOPIC_DLQ).alias("topic"), F.when(exhausted, "transient_exhausted").otherwise(failure).alias("failure_class"), F.when(transient & tier.isNotNull(), retry_delay(attempt)).alias("delay_seconds"))


def due(df: DataFrame, now: Column) -> DataFrame:
    """Jobs whose time has come."""
    return df.where(F.col("job.not_before").isNull() | (F.col("job.not_before") <= now))
