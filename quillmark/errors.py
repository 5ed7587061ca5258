"""Failure classes: which are worth a retry, and what a UDF reports in place of raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every failure class, and whether it may pass (transient).
FAILURE_CLASSES = {
    "unsupported_format": False,
    "corrupt": False,
    "encrypted": False,
    "too_large": False,
    "not_found": False,
    "access_denied": False,
    "blocked_address": False,
    "malware": False,
    "storage_unavailable": True,
    "fetch_timeout": True,
    "ocr_unavailable": True,
    "internal": True,
}


class ParseFailure(Exception):
    def __init__(self, failure: str, reason: str):
        super().__init__(reason)
        self.failure, self.reason = failure, reason


def failure_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAILURE_CLASSES.items()), "failure_class string, transient boolean")


def is_transient(failure: Column) -> Column:
    """Unknown classes are transient, as any crash that nobody classified."""
    permanent = [k for k, v in FAILURE_CLASSES.items() if not v]
    return ~F.coalesce(failure.isin(permanent), F.lit(False))


def storage_failure(status: Column, code: Column) -> Column:
    """Failure class of a storage error by HTTP status and service code; an unknown code may pass."""
    return (
        F.when(code.isin("NoSuchKey", "NoSuchBucket", "NotFound", "NoSuchVersion", "404") | (status == 404) | (status == 410), "not_found")
        .when(code.isin("AccessDenied", "Forbidden", "InvalidAccessKeyId", "SignatureDoesNotMatch", "403", "401"), "access_denied")
        .when(status.between(400, 499) & ~status.isin(408, 429), "access_denied")
        .otherwise("storage_unavailable")
    )
