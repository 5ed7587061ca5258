"""What readers see: status, contents, runs and artifacts, each as a projection of the stored tables, by tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.streaming.lifecycle import is_readable

PARTS = ("text", "blocks", "pages", "tables")
DEFAULT_PARTS = ("text", "blocks", "pages")
MAX_IDS, MAX_QUOTES = 500, 200


class BadRequest(ValueError):
    pass


def scoped(df: DataFrame, tenant: str | None, required: bool = True) -> DataFrame:
    """Rows of a tenant.  The filter reaches the scan; without a tenant nothing matches, unless the caller says that none
    is required (a single-tenant installation)."""
    if tenant is None:
        return df.where("false") if required else df
    return df.where(F.col("tenant_id") == tenant)


def owned(df: DataFrame, tenant: str) -> DataFrame:
    """Rows that may be written for a tenant; another tenant's row ends the job."""
    return df.withColumn("tenant_id", F.when(F.col("tenant_id") == tenant, F.col("tenant_id")).otherwise(F.raise_error(F.lit("a row belongs to another tenant"))))


def status(documents: DataFrame) -> DataFrame:
    """Status rows with the answer's code: 410 for a deleted document."""
    code = F.when(F.col("deleted_at").isNotNull(), 410).otherwise(200)
    return documents.select("id", "status", is_readable(documents).alias("readable"), "content_hash", "media_type", "byte_size", "failure_class", "failure_reason", "created_at", "updated_at", code.alias("code"))


def batch_status(documents: DataFrame, ids: str) -> DataFrame:
    """Status of a comma-separated list of ids; unknown ones are left out."""
    wanted = [x.strip() for x in ids.split(",") if x.strip()]
    if not 1 <= len(wanted) <= MAX_IDS:
        raise BadRequest(f"between 1 and {MAX_IDS} ids are answered at once")
    return status(documents.where(F.col("id").isin(sorted(set(wanted)))))


def etag(run_hash: Column, version: Column) -> Column:
    return F.concat(F.lit('"'), run_hash, F.lit(":"), version, F.lit('"'))


def current(documents: DataFrame, runs: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """Each document with its current run and artifact key; code is 409 without a result, 500 for a dangling pointer."""
    r = runs.select(F.col("id").alias("current_run_id"), "artifact_key", F.col("content_hash").alias("run_hash"), "parser_version")
    df = documents.join(r, "current_run_id", "left")
    code = F.when(F.col("deleted_at").isNotNull(), 410).when(F.col("current_run_id").isNull(), 409)
    if artifacts is not None:
        df = df.join(artifacts.select(F.col("content_hash").alias("run_hash"), F.lit(True).alias("stored")).distinct(), "run_hash", "left")
        code = code.when(F.col("artifact_key").isNull() | F.col("stored").isNull(), 500)
    else:
        code = code.when(F.col("artifact_key").isNull(), 500)
    return df.select("id", "tenant_id", "current_run_id", "artifact_key", etag(F.col("run_hash"), F.col("parser_version")).alias("etag"), code.otherwise(200).alias("code"))


def content(artifacts: DataFrame, include: str | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Chosen parts of the artifacts.  Columns that are not chosen are not read; cells only come with 'tables'."""
    chosen = [x.strip() for x in (include or ",".join(DEFAULT_PARTS)).split(",") if x.strip()]
    if unknown := sorted(set(chosen) - set(PARTS)):
        raise BadRequest(f"unknown part(s): {', '.join(unknown)}")
    out = [F.col("document_id"), F.col("content_hash"), F.col("metadata")]
    if "text" in chosen:
        out.append(F.col("text"))
    if "blocks" in chosen or "tables" in chosen:
        blocks = F.col("blocks") if "tables" in chosen else F.transform("blocks", lambda b: b.dropFields("rows", "header_rows"))
        out.append((blocks if "blocks" in chosen else F.filter(blocks, lambda b: b["type"] == "table")).alias("blocks"))
    df = artifacts.select(*out)
    if "pages" in chosen and pages is not None:
        listed = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("number", "span_start", "span_end", "char_count", "source", "confidence"))).alias("pages"))
        df = df.join(listed, "document_id", "left")
    return df


def not_modified(df: DataFrame, if_none_match: str) -> DataFrame:
    """Marks answers whose tag the reader has."""
    return df.withColumn("code", F.when((F.col("code") == 200) & (F.col("etag") == if_none_match), 304).otherwise(F.col("code")))


def runs_history(runs: DataFrame, documents: DataFrame | None = None, tenant: str | None = None) -> DataFrame:
    """Runs by start, those that never started last; of one tenant's documents if one is given."""
    if documents is not None:
        runs = runs.join(scoped(documents, tenant).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return runs.orderBy("document_id", F.asc_nulls_last("started_at"), "id")


def get_many(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of the ids: none for an unknown one, one for a repeated one."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")


def page_images(images: DataFrame, documents: DataFrame, tenant: str | None, number: int) -> DataFrame:
    """Image keys of a page, for a tenant's readable documents."""
    mine = scoped(documents, tenant)
    return images.where(F.col("number") == number).join(mine.where(is_readable(mine)).select(F.col("id").alias("document_id")), "document_id", "left_semi")


def reprocess(documents: DataFrame, tenant: str | None = None, required: bool = True) -> DataFrame:
    """Outbox rows that ask for documents to be parsed again; 409 for one without a source.  tenant as in ``scoped``."""
    from quillmark.sources.jobs import TOPIC_REQUESTED

    mine = scoped(documents, tenant, required).where("deleted_at IS NULL")
    job = F.to_json(F.struct(F.col("id").alias("document_id"), F.col("source_uri").alias("reference"), "tenant_id", "project_id", "media_type", F.lit(True).alias("force")))
    return mine.select("id", F.when(F.col("source_uri").isNull(), 409).otherwise(202).alias("code"), F.lit(TOPIC_REQUESTED).alias("topic"), F.when(F.col("source_uri").isNotNull(), job.cast("binary")).alias("value"))


def check_quotes(quotes: list[str]) -> list[str]:
    if not 1 <= len(quotes) <= MAX_QUOTES:
        raise BadRequest(f"between 1 and {MAX_QUOTES} quotes are located at once")
    return quotes
