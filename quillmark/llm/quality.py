"""Quality classification by hierarchical empirical Bayes.

A document has the evidence of a classifier on its own text (a logistic model of text statistics, fitted on at most
``LABELLED`` labelled documents).  Its host and its path on the host add what their other documents say: the mean
classifier probability of a path is shrunk toward that of its host, and a host toward the global mean, by prior
strengths estimated from the spread between sites (method of moments).  A sparse site so says nearly nothing and a
large one speaks for itself; a document's own evidence is left out of its path's.  Sites are grouped aggregates,
combined before the shuffle and joined by ``join_groups``, so a host may hold any share of the rows.

Nulls: a null text is empty; a null host or path is the site ''.  A null doc_id keeps its row and is never labelled.
Repeated rows are scored alike; of an id's several texts the one with the smallest features is learned from.  Documents without a single learnable label (or labels of one kind only) all get the
mean label and are kept.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import join_groups, table, written

#: Labelled documents that the classifier is fitted on, at most (those with the smallest hash of their doc_id).
LABELLED = 20_000
#: A document is kept if its posterior quality is at least this.
KEEP = 0.5

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
DIGITS = b"0123456789"
SPACES = b" \t\n\r\x0b\x0c"
PLAIN = b".,;:'\"-()?"
MARKS = b"$%&*#@^~<>{}[]\\/_=+`"
HIGH = bytes(range(128, 256))
N_FEATURES = 18


def features(text: bytes) -> list[float]:
    """Statistics of a UTF-8 text; all of it is read."""
    n = len(text)
    if not n:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    count = lambda chars: n - len(text.translate(None, chars))
    upper, lower, high, space = count(UPPER), count(LOWER), count(HIGH), count(SPACES)
    letters = upper + lower + high
    words = text.split()
    n_words = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    accented = text.decode("utf-8", "replace")
    capital = sum(map(str.isupper, accented)) if high > 0.02 * n else upper
    return [
        np.log1p(n),
        letters / n,
        min(1.0, capital / max(1, letters - high // 2)),
        count(DIGITS) / n,
        space / n,
        10 * count(PLAIN) / n,
        10 * count(MARKS) / n,
        10 * text.count(b"|") / n,
        10 * text.count(b"!") / n,
        sum(map(len, words)) / n_words / 10,
        len(set(words)) / n_words,
        (len(set(words)) / n_words) * np.log1p(n_words) / 10,
        1 - len(set(lines)) / n_lines,
        10 * n_lines / n_words,
        10 * text.count(b". ") / n_words,
        10 * text.count(b"http") / n_words,
        np.log1p(n_words) / 10,
        0.0,
    ]


def with_features(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and the features of every row."""

    def run(batches):
        for b in batches:
            rows = [features(x.as_py() or b"") for x in b.column(3).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "host", "path", "features"])

    site = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), site(host).alias("host"), site(path).alias("path"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, host string, path string, features array<double>")


def expanded(x: np.ndarray) -> np.ndarray:
    """Features, their squares and a constant."""
    return np.concatenate([x, x * x, np.ones((len(x), 1))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, penalty: float = 1e-2) -> dict:
    """Logistic regression by Newton's method on standardised features."""
    full = expanded(x)
    mean, scale = full.mean(axis=0), full.std(axis=0)
    scale[scale < 1e-6] = 1
    mean[-1], scale[-1] = 0, 1
    z = (full - mean) / scale
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty * len(z) ** 0.5 * np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (p - y) + penalty * len(z) ** 0.5 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return {"w": w, "mean": mean, "scale": scale}


def train(rows: DataFrame, labels: DataFrame, limit: int = LABELLED) -> dict | None:
    """The classifier, fitted on at most ``limit`` labelled documents; None if there are not labels of both kinds."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.first("quality").alias("quality")).toPandas().sort_values("doc_id")
    y = found["quality"].to_numpy(np.float64)
    if len(set(y.tolist())) < 2:
        return None
    return fit(np.stack(found["features"].to_numpy()), y)


def _with_evidence(rows: DataFrame, model: dict | None) -> DataFrame:
    """Adds the classifier's log odds and probability."""

    def run(batches):
        for b in batches:
            x = b.column(3).flatten().to_numpy().reshape(b.num_rows, N_FEATURES)
            z = np.zeros(b.num_rows) if model is None else ((expanded(x) - model["mean"]) / model["scale"]) @ model["w"]
            z = np.clip(z, -15, 15)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "host", "path", "logit", "p"])

    return rows.mapInArrow(run, "doc_id long, host string, path string, logit double, p double")


def strength(sites: DataFrame) -> float:
    """Prior strength of the sites' means (columns n, mean, within; prior mean in prior): within / between variance."""
    row = sites.agg(
        F.count(F.lit(1)).alias("sites"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("mean") - F.col("prior")) ** 2).alias("between"), F.sum(F.col("n") * F.col("within")).alias("within")
    ).first()
    if not row["n"]:
        return 1.0
    within = row["within"] / row["n"]
    between = max(0.0, (row["between"] - within * row["sites"]) / row["n"])
    return float(min(1e6, max(1.0, within / between))) if between > 0 else 1e6


def _posterior(p: Column, site: Column, logit: Column, mu: float) -> Column:
    odds = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    return 1 / (1 + F.exp(-(logit + odds(site) - odds(F.lit(mu)))))


def site_key() -> Column:
    """A host and its path as one key: the length of the host keeps them apart."""
    return F.concat_ws(":", F.length("host").cast("string"), "host", "path").alias("site_key")


class Sites:
    """The hierarchy: shrunk means of hosts as priors of their paths, and how much evidence a prior is worth."""

    def __init__(self, scored: DataFrame):
        stats = (F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares"))
        paths = written(scored.groupBy("host", "path").agg(*stats), "quality-paths")
        hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.count(F.lit(1)).alias("paths"))
        hosts = written(hosts, "quality-hosts")
        whole = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        self.n, self.mu = whole["n"] or 0, (whole["total"] or 0.0) / (whole["n"] or 1)
        mean, within = F.col("total") / F.col("n"), F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - (F.col("total") / F.col("n")) ** 2)
        k_host = strength(hosts.select("n", mean.alias("mean"), within.alias("within"), F.lit(self.mu).alias("prior")))
        hosts = hosts.select("host", "paths", ((F.col("total") + k_host * self.mu) / (F.col("n") + k_host)).alias("prior"))
        paths = written(join_groups(paths, hosts, "host", "paths", paths.count()), "quality-priors")
        self.k_path = strength(paths.select("n", mean.alias("mean"), within.alias("within"), "prior"))
        self.table = paths.select(site_key(), F.col("n").alias("site_n"), F.col("total").alias("site_total"), "prior")

    def joined(self, rows: DataFrame, logit: Column | None = None) -> DataFrame:
        """rows (host, path and others) with site and quality; a row's own evidence is not in its site's.

        Rows have logit and p, or logit is how to get it; it is then taken once a row has met its site.
        """
        met = join_groups(rows.select("*", site_key()), self.table, "site_key", "site_n", self.n)
        if logit is not None:
            met = met.withColumn("logit", logit).withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
        site = (F.col("site_total") - F.col("p") + self.k_path * F.col("prior")) / (F.col("site_n") - 1 + self.k_path)
        met = met.withColumn("site", F.least(F.lit(1.0), F.greatest(F.lit(0.0), site)))
        return met.withColumn("quality", _posterior(F.col("p"), F.col("site"), F.col("logit"), self.mu))


def _columns(host: str | Column, path: str | Column | None) -> tuple[Column, Column]:
    return F.col(host) if isinstance(host, str) else host, F.lit("") if path is None else F.col(path) if isinstance(path, str) else path


def quality(docs: DataFrame, labels: DataFrame, host: str | Column = "source", path: str | Column | None = None, limit: int = LABELLED) -> DataFrame:
    """doc_id, host, path, classifier (its probability), site (the path's shrunk mean), quality (posterior), kept.

    host and path are columns of ``docs``; a table without URLs has sections in place of paths (here: languages).
    """
    rows = written(with_features(docs, *_columns(host, path)), "quality-features")
    scored = written(_with_evidence(rows, train(rows, labels, limit)), "quality-evidence")
    out = Sites(scored).joined(scored)
    return out.select("doc_id", "host", "path", F.col("p").alias("classifier"), "site", "quality", (F.col("quality") >= KEEP).alias("kept"))


def drop_poor(docs: DataFrame, labels: DataFrame, host: str | Column = "source", path: str | Column | None = None, limit: int = LABELLED) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The sites are known before the texts are read again, so a text is scored where it stands, and only texts of sites
    with few rows are shuffled, once.
    """
    host, path = _columns(host, path)
    rows = written(with_features(docs, host, path), "quality-features")
    model = train(rows, labels, limit)
    sites = Sites(written(_with_evidence(rows, model), "quality-evidence"))
    site = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), site(host).alias("host"), site(path).alias("path"))

    @F.pandas_udf("double")
    def logit(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.zeros(len(texts)))
        x = np.array([features((t or "").encode("utf-8", "surrogatepass")) for t in texts]).reshape(len(texts), N_FEATURES)
        return pd.Series(np.clip(((expanded(x) - model["mean"]) / model["scale"]) @ model["w"], -15, 15))

    return sites.joined(row, logit(F.col("row.text").cast("string"))).where(F.col("quality") >= KEEP).select("row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "source", "lang")
