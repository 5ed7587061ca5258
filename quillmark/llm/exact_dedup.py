"""Exact duplicates by a cuckoo-filter index of content digests.

Digests are combined within each batch before they are dealt out, so a digest that a third of all rows share reaches
its shard as one row for each batch.  A shard keeps a ``CuckooIndex``: the filter answers first, a hit is verified
against the keys stored for its bucket, and an overflow rebuilds the filter at twice the size from the stored keys.
A shard's rows come in the order of SLOTS slots of the digest; when a slot is through, its digests are reported and
deleted from the index, so the index holds one slot of one shard at a time, however large the table is.

Nulls: a null text counts as empty.  A null doc_id is smaller than any other; keep_id is null only if all ids of the
group are.  Rows that repeat a doc_id with the same text count each in group_size and have the same answer.  An empty
table gives an empty result.  Other columns are not read by the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import join_groups, numbered_partitions, table, written


#: Slots of a shard's digests, by their last bytes.
SLOTS = 4096


class CuckooIndex:
    """Keys (digests of at least 16 bytes) with a value each; insert, find and delete by way of a cuckoo filter."""

    SLOTS = 4
    KICKS = 200

    def __init__(self, buckets: int = 1024):
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.n_buckets = buckets  # a power of two
        self.prints = [[0] * self.SLOTS for _ in range(buckets)]
        self.content: list[dict[bytes, object] | None] = [None] * buckets  # stored keys, by first bucket
        self.size = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "big") or 1
        first = int.from_bytes(key[:8], "big") & (self.n_buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.n_buckets - 1))

    def maybe(self, key: bytes) -> bool:
        """The filter's answer alone: False is certain."""
        mark, a, b = self._places(key)
        return mark in self.prints[a] or mark in self.prints[b]

    def find(self, key: bytes):
        """The value of a live key, or None: a hit of the filter is verified against the stored keys of its bucket."""
        if not self.maybe(key):
            return None
        return (self.content[self._places(key)[1]] or {}).get(key)

    def put(self, key: bytes, value) -> None:
        """Insert a key, or give a live one a new value."""
        mark, home, other = self._places(key)
        own = self.content[home]
        if (mark in self.prints[home] or mark in self.prints[other]) and own is not None and key in own:
            own[key] = value
            return
        if own is None:
            own = self.content[home] = {}
        own[key] = value
        self.size += 1
        if not self._place(key):
            self._resize()

    def _place(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        for bucket in (a, b):
            if 0 in self.prints[bucket]:
                self.prints[bucket][self.prints[bucket].index(0)] = mark
                return True
        bucket = b
        for kick in range(self.KICKS):
            slot = kick % self.SLOTS
            mark, self.prints[bucket][slot] = self.prints[bucket][slot], mark
            bucket = self._other(bucket, mark)
            if 0 in self.prints[bucket]:
                self.prints[bucket][self.prints[bucket].index(0)] = mark
                return True
        return False

    def _resize(self) -> None:
        """Overflow: all stored keys go into a filter of twice the size."""
        held, buckets = list(self.items()), self.n_buckets
        while True:
            buckets *= 2
            self._empty(buckets)
            for key, value in held:
                home = self._places(key)[1]
                if self.content[home] is None:
                    self.content[home] = {}
                self.content[home][key] = value
            self.size = len(held)
            if all(self._place(key) for key, _ in held):
                return

    def delete(self, key: bytes) -> bool:
        """Remove a live key; a key that only shares a print with a live one is left alone."""
        if self.find(key) is None:
            return False
        mark, a, b = self._places(key)
        del self.content[a][key]
        bucket = a if mark in self.prints[a] else b
        self.prints[bucket][self.prints[bucket].index(mark)] = 0
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for own in self.content:
            yield from (own or {}).items()


def normal_bytes(texts: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text with A-Z lower-cased (bytes.lower touches no other letter); null is empty."""
    for x in texts.cast(pa.large_binary()):
        yield (x.as_py() or b"").lower()


def with_digest(docs: DataFrame) -> DataFrame:
    """doc_id and text_digest (32 bytes) of every row."""

    def digest(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(x).digest() for x in normal_bytes(b.column(1))], pa.binary())], names=["doc_id", "text_digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(digest, "doc_id long, text_digest binary")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of a batch."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by("text_digest").aggregate([("doc_id", "max"), ("doc_id", "count", pc.CountOptions(mode="all"))])
        yield from t.select(["text_digest", "doc_id_max", "doc_id_count"]).rename_columns(["text_digest", "keep_id", "group_size"]).to_batches()


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of sorted (slot, digest, keep_id, group_size) rows."""
    index, slot, live, done = CuckooIndex(), None, [], []

    def close() -> None:
        for key in live:
            done.append((key, *index.find(key)))
            index.delete(key)
        live.clear()

    def out() -> pa.RecordBatch:
        keys, best, sizes = zip(*done, strict=True)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(best, pa.int64()), pa.array(sizes, pa.int64())], names=["text_digest", "keep_id", "group_size"])

    for b in batches:
        for at, key, best, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != slot:
                close()
                slot = at
            held = index.find(key)
            if held is None:
                live.append(key)
            else:
                best = held[0] if best is None else best if held[0] is None else max(best, held[0])
                n += held[1]
            index.put(key, (best, n))
        if len(done) >= 10_000:
            yield out()
    close()
    if done:
        yield out()


def digest_groups(digests: DataFrame, shards: int | None = None) -> DataFrame:
    """text_digest, keep_id, group_size: one row for each distinct text."""
    kind = "text_digest binary, keep_id long, group_size long"
    shards = shards or numbered_partitions(digests.sparkSession)
    slot = F.conv(F.hex(F.substring("text_digest", 30, 3)), 16, 10).cast("int") % SLOTS
    dealt = digests.mapInArrow(_combined, kind).select(slot.alias("slot"), "*").repartition(shards, "text_digest").sortWithinPartitions("slot")
    return dealt.mapInArrow(_indexed, kind)


def exact_dedup(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = written(with_digest(docs), "digests")
    groups = written(digest_groups(digests, shards), "digest-groups")
    return join_groups(digests, groups, "text_digest", "group_size", digests.count()).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("text_digest")).alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts one row, with the largest doc_id.

    Of rows that agree in doc_id and text one stays.  The texts take part in one shuffle, on (doc_id, digest); the
    choice of one row needs no other, and the plan is the same at every size.
    """
    groups = written(digest_groups(written(with_digest(docs), "digests")), "digest-groups")
    key = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("keep_key")  # noqa: E731  # equality holds for null ids too
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    lowered = F.translate(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marked = row.select("row", key(F.col("row.doc_id").cast("long")), F.unhex(F.sha2(lowered, 256)).alias("text_digest"))
    kept = marked.join(groups.select(key(F.col("keep_id")), "text_digest").hint("merge"), ["keep_key", "text_digest"], "left_semi")
    return kept.groupBy("keep_key", "text_digest").agg(F.first("row").alias("row")).select("row.*")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
