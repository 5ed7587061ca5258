"""The life of a document and of its parse runs, as merges of keyed snapshots.

Each function takes the control tables and a batch of requests, and returns the tables as they are afterwards; clocks
are arguments.  A batch has one writer, so a claim is exclusive by construction.

documents: id, tenant_id, project_id, status, content_hash, source_uri, media_type, byte_size, current_run_id,
failure_class, failure_reason, created_at, updated_at, deleted_at.
parse_runs: id, document_id, tenant_id, content_hash, parser_version, parse_options_hash, status, artifact_key,
attempt, lease_expires_at, trace_id, started_at, finished_at, failure_class, failure_reason.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Moves of a document's status, states that can be claimed, seconds of a lease.
MOVES = {"pending": ("processing", "failed", "deleted"), "processing": ("ready", "failed", "deleted"), "ready": ("processing", "ready", "deleted"), "failed": ("processing", "deleted"), "deleted": ()}
CLAIMABLE = ("pending", "failed")
LEASE_SECONDS = 1800
DOCUMENTS = "id string, tenant_id string, project_id string, status string, content_hash string, source_uri string, media_type string, byte_size bigint, current_run_id string, failure_class string, failure_reason string, created_at timestamp, updated_at timestamp, deleted_at timestamp"
RUNS = "id string, document_id string, tenant_id string, content_hash string, parser_version string, parse_options_hash string, status string, artifact_key string, attempt int, lease_expires_at timestamp, trace_id string, started_at timestamp, finished_at timestamp, failure_class string, failure_reason string"
RUN_KEY = ("document_id", "content_hash", "parser_version", "parse_options_hash")


def names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def may_move(old: Column, new: Column) -> Column:
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)).cast("array<string>") for pair in MOVES.items() for x in pair))
    return F.coalesce(F.array_contains(F.element_at(table, old), new), F.lit(False))


def is_readable(df: DataFrame) -> Column:
    """A document can be read once it has a result and is not deleted, whatever its status."""
    return df["deleted_at"].isNull() & df["current_run_id"].isNotNull()


def _set(df: DataFrame, when: Column, **values: Column) -> DataFrame:
    return df.select(*(F.when(when, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns))


def _marked(df: DataFrame, ids: DataFrame, key: str, mark: str) -> DataFrame:
    return df.join(ids.select(F.col(key).alias("id")).distinct().withColumn(mark, F.lit(True)), "id", "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def register(documents: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Insert what is new; known documents are never reset, only their unknown fields are filled.

    jobs: document_id, offset, tenant_id, project_id, reference, media_type, size; of a document's jobs the one of the
    smallest offset counts, and for what it leaves open the next one.
    """
    new = jobs.groupBy(F.col("document_id").alias("id")).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("offset"))).alias(f"new_{c}") for c in ("tenant_id", "project_id", "reference", "media_type", "size")))
    both = documents.join(new, "id", "full_outer")
    fresh = F.col("status").isNull()
    filled = {"tenant_id": "new_tenant_id", "project_id": "new_project_id", "source_uri": "new_reference", "media_type": "new_media_type", "byte_size": "new_size"}
    out = {c: F.coalesce(F.col(c), F.col(n)) for c, n in filled.items()} | {"tenant_id": F.when(fresh, F.col("new_tenant_id")).otherwise(F.col("tenant_id"))}
    out |= {"status": F.coalesce("status", F.lit("pending")), "created_at": F.coalesce("created_at", now), "updated_at": F.coalesce("updated_at", now)}
    return both.select(*(out.get(c, F.col(c)).alias(c) for c in names(DOCUMENTS)))


def claim(documents: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(documents, outcome): claimable documents become processing; outcome has id, claimed and the reason if not.

    ids: document_id, one row for each request; of repeated requests the first gets the claim.
    """
    asked = ids.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("requests"))
    known = documents.select("id", "status", "deleted_at")
    free = F.col("status").isin(*CLAIMABLE) & F.col("deleted_at").isNull()
    reason = F.when(F.col("status").isNull(), "unknown document").when(F.col("deleted_at").isNotNull() | (F.col("status") == "deleted"), "deleted").when(~free, F.concat(F.lit("status is "), F.col("status")))
    outcome = asked.join(known, "id", "left").select("id", F.coalesce(free, F.lit(False)).alias("claimed"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    marked = _marked(documents, outcome.where("claimed"), "id", "_mine")
    return _set(marked, F.col("_mine"), status=F.lit("processing"), failure_class=none, failure_reason=none, updated_at=now).select(*names(DOCUMENTS)), outcome


def first_claims(jobs: DataFrame) -> DataFrame:
    """The first job of each document by offset: the one that a batch works on."""
    w = Window.partitionBy("document_id").orderBy("offset")
    return jobs.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def run_id(*key: str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)), 256)


def start_runs(runs: DataFrame, requests: DataFrame, now: Column, lease: int = LEASE_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(runs, started): a run for each request whose key has no success and no live run; a failed run may be retried.

    requests: document_id, tenant_id, content_hash, parser_version, parse_options_hash, trace_id.
    """
    live = runs.where((F.col("status") == "succeeded") | ((F.col("status") == "running") & (F.col("lease_expires_at") > now)))
    before = runs.groupBy(*RUN_KEY).agg(F.max("attempt").alias("before"))
    fresh = requests.dropDuplicates(list(RUN_KEY)).join(live.select(*RUN_KEY), list(RUN_KEY), "left_anti").join(before, list(RUN_KEY), "left")
    fresh = fresh.withColumn("attempt", (F.coalesce("before", F.lit(0)) + 1).cast("int"))
    none = F.lit(None).cast("string")
    values = {"id": run_id(*RUN_KEY, "attempt"), "status": F.lit("running"), "artifact_key": none, "lease_expires_at": now + F.make_dt_interval(secs=F.lit(lease)), "started_at": now, "finished_at": F.lit(None).cast("timestamp"), "failure_class": none, "failure_reason": none}
    started = fresh.select(*(values.get(c, F.col(c)).alias(c) for c in names(RUNS)))
    return runs.unionByName(started), started


def complete_runs(documents: DataFrame, runs: DataFrame, done: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Runs succeed and their documents point at them; a document that was deleted meanwhile stays deleted.

    done: id, artifact_key, content_hash.
    """
    d = done.select("id", F.col("artifact_key").alias("_key"), F.col("content_hash").alias("_hash"))
    after = _set(runs.join(d, "id", "left"), F.col("_key").isNotNull(), status=F.lit("succeeded"), artifact_key=F.col("_key"), finished_at=now).select(*names(RUNS))
    latest = runs.join(d, "id").groupBy(F.col("document_id").alias("id")).agg(F.max_by(F.struct(F.col("id").alias("_run"), "_hash"), F.struct("started_at", "attempt")).alias("_done")).select("id", "_done.*")
    marked = documents.join(latest, "id", "left")
    docs = _set(marked, F.col("_run").isNotNull() & F.col("deleted_at").isNull(), status=F.lit("ready"), current_run_id=F.col("_run"), content_hash=F.col("_hash"), failure_class=F.lit(None).cast("string"), failure_reason=F.lit(None).cast("string"), updated_at=now)
    return docs.select(*names(DOCUMENTS)), after


def fail_runs(documents: DataFrame, runs: DataFrame, failed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Runs fail; a document without a result becomes failed for a lasting reason, else pending again.

    failed: document_id, run_id (may be null: the document never got that far), failure_class, failure_reason, final.
    """
    by_run = failed.where("run_id IS NOT NULL").select(F.col("run_id").alias("id"), F.col("failure_class").alias("_class"), F.col("failure_reason").alias("_reason"))
    after = _set(runs.join(by_run, "id", "left"), F.col("_class").isNotNull(), status=F.lit("failed"), failure_class=F.col("_class"), failure_reason=F.col("_reason"), finished_at=now).select(*names(RUNS))
    by_doc = failed.groupBy(F.col("document_id").alias("id")).agg(F.max("final").alias("_final"), F.first("failure_class").alias("_class"), F.first("failure_reason").alias("_reason"))
    open_ = F.col("_class").isNotNull() & F.col("current_run_id").isNull() & F.col("deleted_at").isNull()
    docs = _set(documents.join(by_doc, "id", "left"), open_, status=F.when(F.col("_final"), "failed").otherwise("pending"), failure_class=F.col("_class"), failure_reason=F.col("_reason"), updated_at=now)
    return docs.select(*names(DOCUMENTS)), after


def reclaim_expired(documents: DataFrame, runs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Running runs whose lease has passed fail; their documents are pending again."""
    late = (F.col("status") == "running") & (F.col("lease_expires_at") <= now)
    lost = runs.where(late).select("document_id")
    after = _set(runs, late, status=F.lit("failed"), failure_class=F.lit("lease_expired"), failure_reason=F.lit("the lease of the run expired"), finished_at=now)
    marked = _marked(documents, lost, "document_id", "_lost")
    return _set(marked, F.col("_lost") & (F.col("status") == "processing"), status=F.lit("pending"), updated_at=now).select(*names(DOCUMENTS)), after


def mark_deleted(documents: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    marked = _marked(documents, ids, "document_id", "_gone")
    return _set(marked, F.col("_gone") & F.col("deleted_at").isNull(), status=F.lit("deleted"), deleted_at=now, updated_at=now).select(*names(DOCUMENTS))


class ControlStore:
    """Both control tables as versioned snapshots.  A pointer file, renamed last, says which version holds, so the two
    change together; the batch that wrote a version stands in it, so a repeated batch is known."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def pointer(self) -> dict:
        fs, path = self._fs(f"{self.folder}/_CURRENT")
        if not fs.exists(path):
            return {"version": None, "batch": None}
        stream = fs.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def read(self) -> tuple[DataFrame, DataFrame]:
        version = self.pointer()["version"]
        if version is None:
            return self.spark.createDataFrame([], DOCUMENTS), self.spark.createDataFrame([], RUNS)
        top = f"{self.folder}/{version}"
        return self.spark.read.schema(DOCUMENTS).parquet(f"{top}/documents"), self.spark.read.schema(RUNS).parquet(f"{top}/parse_runs")

    def commit(self, documents: DataFrame, runs: DataFrame, batch: int | None = None) -> str:
        version = uuid.uuid4().hex
        documents.write.parquet(f"{self.folder}/{version}/documents")
        runs.write.parquet(f"{self.folder}/{version}/parse_runs")
        fs, new = self._fs(f"{self.folder}/_CURRENT.{version}")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps({"version": version, "batch": batch}).encode()))
        stream.close()
        self._replace(new, self._fs(f"{self.folder}/_CURRENT")[1])
        return version

    def _replace(self, new, old) -> None:
        """Rename over the old pointer in one step."""
        sc = self.spark.sparkContext
        kind = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
        over = sc._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), sc._jsc.hadoopConfiguration()).rename(new, old, over)
