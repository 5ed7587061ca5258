"""SimHash near duplicates, found by pigeonring filtering.

A fingerprint is cut into a ring of ``SEGMENTS`` segments.  If two fingerprints differ in at most ``BITS`` bits, some
segment of the ring starts a chain whose first l segments differ in at most floor(l * BITS / SEGMENTS) bits, for every
l (the pigeonring principle).  Each fingerprint is dealt out once for each start, under the segments that a chain may
not (or hardly) differ in; within a key only pairs whose whole chain stays within the budgets get the full Hamming
check.  A key's fingerprints give a spanning forest of their links, not all pairs, so a group of g near copies costs
at most g - 1 rows for each start; a key of very many fingerprints is cut into blocks and every pair of blocks is
compared in a task of its own.

Only distinct fingerprints are compared, so copies cost nothing.  How many segments stand in the key follows from the
number of distinct fingerprints; every choice finds the same links.

Nulls: a null text has no words, so its fingerprint is zero, linked like any other.  A null doc_id takes no part in
the minimum; component_id is null only if all ids of the component are.  Repeated rows each have the same answer.  An
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import shingles
from quillmark.llm.common import HOT_SHARE, join_groups, numbered_partitions, table, written
from quillmark.llm.components import components

SEGMENTS, WIDTH, BITS = 8, 8, 3
SEED = 42
#: Words of a shingle window handled at once; fingerprints of a key compared at once (more are cut into blocks).
CHUNK_WORDS = 1 << 15
BLOCK = 2048


def fingerprint(text: bytes, size: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text: bit set if it is set in over half of the shingle hashes."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    if len(words) < size:
        return int.from_bytes(digest(join(words), SEED), "big")
    n = len(words) - size + 1
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, CHUNK_WORDS):
        part = words[lo : lo + CHUNK_WORDS + size - 1]
        raw = b"".join([digest(x, SEED) for x in map(join, zip(*(part[i:] for i in range(size)), strict=False))])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for b in batches:
            prints = [fingerprint(x.as_py() or b"", size) for x in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def chain_length(n: int) -> int:
    """Segments in the key: a key then has few fingerprints by chance, up to about 2**40 of them."""
    return 2 if n <= 1 << 22 else 3 if n <= 1 << 30 else 5


def ring_keys(prints: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint turned so that the chain starts at the top), for every start of the ring.

    The first two segments of a chain may not differ (2 * BITS / SEGMENTS < 1), so they stand whole in the key.  Up to
    five may differ in one bit: each key leaves out one bit of the third to the last, so that a pair with one such
    difference meets under the key that leaves it out.
    """
    keys, turned = [], []
    for start in range(SEGMENTS):
        shift = np.uint64(WIDTH * start)
        turn = prints if not start else (prints << shift) | (prints >> np.uint64(64 - WIDTH * start))
        base = turn >> np.uint64(64 - WIDTH * chain)
        free = WIDTH * (chain - 2)
        for bit in range(max(1, free)):
            kept = base if not free else base & ~np.uint64(1 << bit)
            mark = np.uint64(start * max(1, free) + bit)
            keys.append((kept << np.uint64(9)) | mark)
            turned.append(turn)
    return np.concatenate(keys), np.concatenate(turned)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs (turned to the chain's start) within the budgets of every prefix of the chain, then within BITS."""
    differ = a ^ b
    alive = np.ones(differ.shape, bool)
    for segments in range(1, SEGMENTS + 1):
        budget = segments * BITS // SEGMENTS
        if (segments + 1) * BITS // SEGMENTS > budget or segments == SEGMENTS:  # the last prefix with this budget
            alive &= np.bitwise_count(differ >> np.uint64(64 - WIDTH * segments)) <= budget
    return alive


def forest(prints: np.ndarray, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions (i, j) of a spanning forest of the links among ``prints``.

    With ``left`` (a mask), only links between a marked and an unmarked fingerprint count.
    """
    out: list[tuple[int, int]] = []
    rest = np.arange(len(prints))
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = near(prints[i], prints[rest])
            if left is not None:
                hit &= left[rest] != left[i]
            if hit.any():
                found = rest[hit]
                rest = rest[~hit]
                out += [(i, j) for j in found.tolist()]
                todo += found.tolist()
    return out


def _group_links(keys: np.ndarray, prints: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys (whole groups, sorted by key)."""
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(bounds)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    small = np.repeat(sizes <= 32, sizes) & (sides == 0)
    for d in range(1, min(32, int(sizes.max(initial=0)))):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:] & small[:-d])
        i = i[near(prints[i], prints[i + d])]
        a.append(prints[i])
        b.append(prints[i + d])
    for g in np.flatnonzero((sizes > 32) | (sides[bounds[:-1]] > 0)).tolist():
        lo, hi = int(bounds[g]), int(bounds[g + 1])
        own, side = prints[lo:hi], sides[lo:hi]
        pairs = np.array(forest(own, side == 1 if side[0] else None), np.int64).reshape(-1, 2)
        a.append(own[pairs[:, 0]])
        b.append(own[pairs[:, 1]])
    return np.concatenate(a or [prints[:0]]), np.concatenate(b or [prints[:0]])


def _turned_back(prints: np.ndarray, start: np.ndarray) -> np.ndarray:
    shift = (start * WIDTH).astype(np.uint64)
    return np.where(start == 0, prints, (prints >> shift) | (prints << ((np.uint64(64) - shift) % np.uint64(64))))


def _links(batches: Iterator[pa.RecordBatch], chain: int) -> Iterator[pa.RecordBatch]:
    """Links of sorted (key, part, side, turned) rows; the last, perhaps unfinished group waits for the next batch."""
    per_start = max(1, WIDTH * (chain - 2))
    held: list[np.ndarray] | None = None

    def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, part, side, turned = cols
        if not len(key):
            return
        change = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        run = np.cumsum(change)
        # the start of a link's chain is in its key; each start is turned back by its own amount
        start = (key.astype(np.uint64) & np.uint64(511)).astype(np.int64) // per_start
        for s in np.unique(start).tolist():
            own = start == s
            a, b = _group_links(run[own], turned[own].view(np.uint64), side[own])
            if len(a):
                at = np.full(len(a), s)
                yield pa.RecordBatch.from_arrays([pa.array(_turned_back(x, at).view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        key, part = cols[0], cols[1]
        last = np.flatnonzero((key != key[-1]) | (part != part[-1])) if len(key) else np.zeros(0, np.int64)
        cut = int(last[-1]) + 1 if len(last) else 0
        yield from emit([c[:cut] for c in cols])
        held = [c[cut:] for c in cols]
    if held is not None:
        yield from emit(held)


def near_links(prints: DataFrame, n: int, chain: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that differ in at most BITS bits, enough of them to keep
    every component connected: a spanning forest for each key."""
    spark = prints.sparkSession
    chain = chain or chain_length(n)

    def spread(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(fp), 4096):
                keys, turned = ring_keys(fp[lo : lo + 4096], chain)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(turned.view(np.int64))], names=["key", "turned"])

    rows = prints.select("fp").mapInArrow(spread, "key long, turned long")
    hot = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > block), "hot-keys")
    # a key of over 1/HOT_SHARE of all rows meets its count by broadcast; a shuffle brings together small keys only
    share = F.col("held") * HOT_SHARE > n * SEGMENTS * max(1, WIDTH * (chain - 2))
    most = F.broadcast(hot.where(share))
    others = rows.join(most.select("key"), "key", "left_anti").join(hot.where(~share), "key", "left")
    # a hot key's fingerprints fall into n blocks; block i meets block j in part (i, j), once for i = j
    blocks = F.coalesce(F.ceil(F.col("held") / block), F.lit(1)).cast("int")
    rows = (
        rows.join(most, "key")
        .unionByName(others)
        .select("key", "turned", blocks.alias("blocks"), F.pmod(F.xxhash64("turned"), blocks).cast("int").alias("own"))
        .select("key", "turned", "blocks", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(
            "key",
            (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).cast("int").alias("part"),
            F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
            "turned",
        )
    )
    dealt = rows.repartition(numbered_partitions(spark), "key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(lambda batches: _links(batches, chain), "a long, b long")


def simhash_components(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links) of every row."""
    prints = written(with_fingerprint(docs, size), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("held")), "distinct-fingerprints")
    roots = components(near_links(nodes, nodes.count()))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first_id", "held", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "roots")
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    labels = join_groups(placed, ids, "root", "prints", placed.count()).select("fp", "held", "component_id")
    joined = join_groups(prints, written(labels, "labels"), "fp", "held", prints.count())
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each component of texts with similar shingles.

    It is the row with the smallest doc_id, one without a doc_id only if the component has no other; of several the
    one of the smallest text.  Rows are told apart by their words and doc_id, both taken from the row where it stands, so
    rows that share a doc_id, or have none, are never mixed up with those of another component.  The texts take part in
    one shuffle, on words and doc_id, at every size.  Candidates come by ``near_links`` first, by MinHash where the bits do
    not reach; each link is verified (``shingles``).
    """
    words = F.arrow_udf(lambda texts: pa.array([shingles.node_of(shingles.words_of(x.as_py() or b"")) for x in texts.cast(pa.large_binary())], pa.binary()), "binary")
    key = lambda node, c: F.concat_ws("/", F.hex(node), c.cast("string")).alias("keep_key")  # noqa: E731  # a null id adds nothing
    found = shingles.similar_components(docs, search=near_links)
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")).alias("least"))
    keep = least.select(key(F.col("least.node"), F.col("least.doc_id")))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("text", F.col("row.text").cast("string"))
    row = row.select("row", "text", key(words("text"), F.col("row.doc_id").cast("long")))
    kept = row.join(written(keep, "keepers").hint("merge"), "keep_key", "left_semi")
    return kept.groupBy("keep_key").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row")).select("row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
