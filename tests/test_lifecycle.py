import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmark.config import ConfigError, Settings
from quillmark.operators import serving
from quillmark.sources import files, jobs
from quillmark.streaming import lifecycle as life
from quillmark.streaming.ingest import Ingest, table_fetcher

T0 = datetime(2024, 6, 1)
at = lambda minutes=0: F.lit(T0 + timedelta(minutes=minutes))


def empty(spark):
    return spark.createDataFrame([], life.DOCUMENTS), spark.createDataFrame([], life.RUNS)


def job_rows(spark, *ids):
    return spark.createDataFrame([(i, at, "t", None, f"s3://b/{i}", None, 5) for at, i in enumerate(ids)], "document_id string, offset long, tenant_id string, project_id string, reference string, media_type string, size long")


def requests(spark, *ids):
    return spark.createDataFrame([(i, "t", f"h{i}", "1.0", "", None) for i in ids], "document_id string, tenant_id string, content_hash string, parser_version string, parse_options_hash string, trace_id string")


def state(df):
    return {r["id"]: r["status"] for r in df.collect()}


def test_a_document_from_request_to_result(spark):
    docs, runs = empty(spark)
    docs = life.register(docs, job_rows(spark, "a", "b"), at())
    assert state(docs) == {"a": "pending", "b": "pending"}
    docs, outcome = life.claim(docs, job_rows(spark, "a", "a", "zz"), at())
    assert {(r["id"], r["claimed"], r["reason"]) for r in outcome.collect()} == {("a", True, None), ("zz", False, "unknown document")}
    assert life.claim(docs, job_rows(spark, "a"), at())[1].first()["reason"] == "status is processing"
    runs, started = life.start_runs(runs, requests(spark, "a"), at())
    assert started.count() == 1 and life.start_runs(runs, requests(spark, "a"), at(1))[1].count() == 0
    done = started.select("id", F.lit("parsed/ha").alias("artifact_key"), "content_hash")
    docs, runs = life.complete_runs(docs, runs, done, at(2))
    row = docs.where("id = 'a'").first()
    assert row["status"] == "ready" and row["content_hash"] == "ha" and docs.where(life.is_readable(docs)).count() == 1
    assert life.start_runs(runs, requests(spark, "a"), at(99))[1].count() == 0
    again = life.register(docs, job_rows(spark, "a"), at(3))
    assert state(again)["a"] == "ready" and again.count() == 2


def test_failures_leases_and_deletion(spark):
    docs = life.register(empty(spark)[0], job_rows(spark, "a", "b", "c"), at())
    docs, _ = life.claim(docs, job_rows(spark, "a", "b", "c"), at())
    runs, started = life.start_runs(empty(spark)[1], requests(spark, "a", "b", "c"), at())
    bad = started.where("document_id <> 'c'").select("document_id", F.col("id").alias("run_id"), F.lit("corrupt").alias("failure_class"), F.lit("x").alias("failure_reason"), (F.col("document_id") == "a").alias("final"))
    docs, runs = life.fail_runs(docs, runs, bad, at(1))
    assert state(docs) == {"a": "failed", "b": "pending", "c": "processing"}
    assert life.start_runs(runs, requests(spark, "b"), at(2))[1].first()["attempt"] == 2
    docs, runs = life.reclaim_expired(docs, runs, at(29))
    assert state(docs)["c"] == "processing"
    docs, runs = life.reclaim_expired(docs, runs, at(30))
    assert state(docs)["c"] == "pending" and runs.where("failure_class = 'lease_expired'").count() == 1
    docs = life.mark_deleted(docs, job_rows(spark, "c"), at(31))
    done = started.where("document_id = 'c'").select("id", F.lit("k").alias("artifact_key"), "content_hash")
    docs, _ = life.complete_runs(docs, runs, done, at(32))
    assert state(docs)["c"] == "deleted" and life.claim(docs, job_rows(spark, "c"), at(33))[1].first()["reason"] == "deleted"


def test_snapshots_change_together_and_know_their_batch(spark, tmp_path):
    store = life.ControlStore(spark, f"file://{tmp_path}/control")
    assert store.pointer()["version"] is None and store.read()[0].count() == 0
    docs = life.register(empty(spark)[0], job_rows(spark, "a"), at())
    store.commit(docs, empty(spark)[1], 0)
    store.commit(life.register(store.read()[0], job_rows(spark, "b"), at()), store.read()[1], 1)
    assert state(store.read()[0]) == {"a": "pending", "b": "pending"} and store.pointer()["batch"] == 1


def message(offset, body, topic=jobs.TOPIC_REQUESTED):
    value = body if isinstance(body, bytes) else json.dumps(body).encode()
    return (f"k{offset}", bytearray(value), [], topic, 0, offset, T0)


def event(n, **more):
    return {"event_id": f"e{n}", "document_id": f"d{n}", "tenant_id": "t1", "s3_bucket": "b", "s3_key": f"/in/{n}.md", "filename": f"{n}.md"} | more


def test_streaming_ingest_is_replayable(spark, tmp_path):
    inbox = f"{tmp_path}/inbox"
    rows = [message(0, event(1)), message(1, event(2)), message(2, event(1)), message(3, b"no json"), message(4, event(3, tenant_id=" ")), message(5, event(4, filename="4.json")), message(6, event(5)), message(7, {"document_id": "d6", "reference": "s3://b/in/6.md", "tenant_id": "t1", "filename": "6.md", "attempt": 2, "not_before": "2999-01-01T00:00:00Z"})]
    spark.createDataFrame(rows, files.MESSAGE).write.parquet(inbox)
    blobs = spark.createDataFrame([("s3://b/in/1.md", bytearray(b"# One\n\ntext")), ("s3://b/in/2.md", bytearray(b"- a\n- b")), ("s3://b/in/4.md", bytearray(b"{}"))], "reference string, content binary")
    ingest = Ingest(spark, f"file://{tmp_path}/engine", table_fetcher(blobs))
    q = ingest.start(files.message_stream(spark, inbox), once=True)
    q.awaitTermination()
    assert q.exception() is None
    docs, runs = ingest.store.read()
    assert state(docs) == {"d1": "ready", "d2": "ready", "d4": "failed", "d5": "failed"}
    assert {r["document_id"]: r["status"] for r in runs.collect()} == {"d1": "succeeded", "d2": "succeeded", "d4": "failed"}
    out = [(r["topic"], r["key"], r["headers"]) for r in spark.read.parquet(f"{tmp_path}/engine/outbox/batch=0").collect()]
    topics = sorted((t.rpartition(".")[2], k) for t, k, _ in out)
    assert topics == [("completed", "d1"), ("completed", "d2"), ("dlq", "d4"), ("dlq", "d5"), ("dlq", "k3"), ("dlq", "k4"), ("requested", "d6")]
    assert {h["failure_class"] for t, k, h in out if t == jobs.TOPIC_DLQ} == {"unsupported_format", "not_found", "malformed_event"}
    before = ingest.store.pointer()
    ingest.process(spark.read.schema(files.MESSAGE).parquet(inbox), 0)  # the same batch again
    assert ingest.store.pointer() == before
    again = ingest.start(files.message_stream(spark, inbox), once=True)
    again.awaitTermination()
    assert ingest.store.pointer() == before


def test_retries_and_routing(spark):
    df = spark.createDataFrame([(i, f) for i in range(1, 6) for f in ("corrupt", "fetch_timeout", "never heard of")], "attempt int, failure string")
    from quillmark.errors import is_transient

    got = {(r["attempt"], r["failure"]): (r["r"]["topic"].rpartition(".")[2], r["r"]["failure_class"], r["r"]["delay_seconds"]) for r in df.select("attempt", "failure", jobs.route(F.col("failure"), F.col("attempt"), is_transient(F.col("failure"))).alias("r")).collect()}
    assert got[1, "corrupt"] == ("dlq", "corrupt", None) and got[1, "fetch_timeout"] == ("30s", "fetch_timeout", 30)
    assert got[3, "never heard of"] == ("30m", "never heard of", 1800) and got[4, "fetch_timeout"] == ("dlq", "transient_exhausted", None)


def test_serving_is_scoped_to_a_tenant(spark):
    docs = life.register(empty(spark)[0], job_rows(spark, "a").unionByName(job_rows(spark, "b").withColumn("tenant_id", F.lit("u"))), at())
    assert [r["id"] for r in serving.scoped(docs, "u").collect()] == ["b"]
    assert serving.scoped(docs, None).count() == 0 and serving.scoped(docs, None, required=False).count() == 2
    with pytest.raises(Exception, match="another tenant"):
        serving.owned(docs, "u").collect()
    with pytest.raises(serving.BadRequest):
        serving.batch_status(docs, " , ")
    with pytest.raises(serving.BadRequest):
        serving.content(docs, "text,images")
    with pytest.raises(serving.BadRequest):
        serving.check_quotes([])
    plan = serving.scoped(docs, "u")._jdf.queryExecution().optimizedPlan().toString()
    assert "tenant_id" in plan


def test_local_files_stay_below_their_roots(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_bytes(b"# A")
    (tmp_path / "in/empty.md").write_bytes(b"")
    (tmp_path / "in/big.md").write_bytes(b"x" * 50)
    roots = (str(tmp_path / "in"),)
    df = files.read_blobs(spark, str(tmp_path / "in"), roots, max_bytes=20)
    assert [r["filename"] for r in df.collect()] == ["a.md"]
    assert "length" in df._jdf.queryExecution().executedPlan().toString()
    assert {r["failure"] for r in files.refused_blobs(spark, str(tmp_path / "in"), roots, max_bytes=20).collect()} == {"too_large"}
    for path in (str(tmp_path), str(tmp_path / "in/../x"), "/etc"):
        with pytest.raises(files.RefusedPath):
            files.read_blobs(spark, path, roots)
    with pytest.raises(files.RefusedPath):
        files.read_blobs(spark, str(tmp_path / "in"), ())


def test_settings():
    s = Settings.from_env({"S3_BUCKET": "b", "S3_PREFIX": "/raw/", "ALLOW_PRIVATE_NETWORKS": "true", "LOCAL_ROOTS": "/a, /b", "DATABASE_URL": "postgres://me:secret@h:1/d", "AWS_SECRET_ACCESS_KEY": "0123456789"})
    assert s.s3_prefix == "raw/" and s.artifact_bucket == "b" and s.allow_private_networks and s.local_roots == ("/a", "/b") and s.max_fetch_bytes == 104857600
    shown = str(s.describe())
    assert "secret@" not in shown and "0123456789" not in shown and s.describe()["database_role"] == "me" and "secret" not in repr(s)
    with pytest.raises(ConfigError):
        s.require_storage()
    with pytest.raises(ConfigError):
        Settings.from_env({"OCR_DPI": "many"})
    assert Settings.from_env({"AWS_REGION": "r"}).spark_conf() == {"spark.hadoop.fs.s3a.endpoint.region": "r"}


def test_artifacts_are_never_overwritten(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillmark.plans.documents import artifact_exists, build, delete_artifacts, read_artifacts, write_artifacts

    folder = str(tmp_path)
    raw = lambda *ids: build(spark.createDataFrame([(f"d{i}", f"d{i}.md", None, f"# head {i}\n\ntext {i}".encode()) for i in ids], "document_id string, filename string, declared_media_type string, content binary"))
    for ids in ((15,), (32,), (15, 32, 40), (40,)):
        write_artifacts(raw(*ids), folder)
    held = read_artifacts(spark, folder)
    assert sorted(r["document_id"] for r in held.artifacts.collect()) == ["d15", "d32", "d40"]
    assert sorted((r["document_id"], r["type"]) for r in held.blocks.collect()) == sorted((f"d{i}", t) for i in (15, 32, 40) for t in ("heading", "paragraph"))
    key = held.artifacts.where("document_id = 'd32'").select("artifact_key")
    one = read_artifacts(spark, folder, key)
    assert [r["text"] for r in one.artifacts.collect()] == ["# head 32\n\ntext 32"] and one.blocks.count() == 2
    delete_artifacts(spark, folder, key)
    assert [r["stored"] for r in artifact_exists(spark, folder, key).collect()] == [False] and read_artifacts(spark, folder).artifacts.count() == 2
    write_artifacts(raw(32), folder)
    assert [r["stored"] for r in artifact_exists(spark, folder, key).collect()] == [True]
    assert artifact_exists(spark, folder, spark.range(1).select(F.lit("parsed/none").alias("artifact_key"))).first()["stored"] is False


def test_the_first_job_by_offset_registers_a_document(spark):
    rows = [("a", 5, "t2", "r2"), ("a", 3, "t1", None), ("a", 9, "t3", "r3")]
    jobs = spark.createDataFrame(rows, "document_id string, offset long, tenant_id string, reference string").selectExpr("*", "cast(null as string) project_id", "cast(null as string) media_type", "cast(null as long) size")
    row = life.register(empty(spark)[0], jobs.repartition(3), at()).first()
    assert (row["tenant_id"], row["source_uri"]) == ("t1", "r2")
