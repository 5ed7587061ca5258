"""Near copies by the words they share: components of texts whose sets of five-word shingles have a Jaccard similarity
of SIMILAR or more.

Candidates come by SimHash first: 64-bit fingerprints of the shingle sets, linked by a given search (pigeonring filtering);
texts of one fingerprint are candidates of the least of them.  At a similarity of 0.8 two fingerprints differ in about 10
bits, and a budget that finds nearly all such pairs (17) leaves pigeonring nothing to prune, so its few bits reach
the close copies only.  For the other pairs, those whose groups SimHash has not joined, candidates meet by MinHash in
BANDS bands of ROWS values: a pair of similarity s is missed by (1 - s**ROWS)**BANDS, less than one in ten thousand at 0.8
and one in 10**9 at 0.9.  Every link is verified on the whole shingle sets, so no other document is lost; where
a bucket's pairs are many, the sketches are compared first (a byte of each MinHash value: pairs at 0.8 differ in 24 of
120 on average, and SKETCH_BITS is five standard deviations beyond).

A bucket's texts are first held against one of them, another in each round (first the text with the most bucket mates),
which joins a group of g near copies in about g comparisons; that one is then done with.  Rounds go on while they settle
half of what is open; then the pairs that remain in buckets of several groups are compared in blocks, each pair in the
first band that it has in common.

Shingle sets are never written, as they take twice the room of the texts: sketches are kept for every text, and the words
of texts with a candidate, from which each comparison makes its sets anew.

Words are split and lowered as for SimHash (ASCII only); a text of fewer than SIZE words is one shingle, and texts without
words are equal.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import HOT_SHARE, join_groups, numbered_partitions, written
from quillmark.llm.components import components

SIZE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 5
SEED = 43
#: Differing bytes of two sketches at which a pair is no candidate any more.
SKETCH_BITS = 46
#: Shingles hashed for all bands at once; texts of an unresolved bucket compared at once (more are cut into blocks).
CHUNK = 1 << 12
BLOCK = 256
#: Rounds of one text against its bucket that are always made, before all remaining pairs are compared.
STARS = 1
#: Comparisons with one text in one task; more are dealt out to several.
RUN = 500
#: Most bits of the filter of ids that is broadcast (16 MB), and bits for each id below that.
FILTER_BITS = 1 << 27
ID_BITS = 64
#: Tasks that a key of over 1/HOT_SHARE of all rows is dealt out over.
SALTS = 64

_RNG = np.random.default_rng(SEED)
_MASK = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def node_of(words: list[bytes]) -> bytes:
    """16 bytes that stand for a text's words."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_digest, b" ".join
    parts = zip(*(words[i:] for i in range(SIZE)), strict=False) if len(words) >= SIZE else [words]
    return np.unique(np.frombuffer(b"".join([digest(x, SEED) for x in map(join, parts)]), np.uint64))


def sketch_of(found: np.ndarray) -> np.ndarray:
    """The highest byte of each of BANDS * ROWS MinHash values of a set; none for a text without words."""
    if not len(found):
        return np.zeros(0, np.uint8)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(found), CHUNK):
        least = np.minimum(least, ((found[lo : lo + CHUNK] ^ _MASK) * _ODD).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint8)


def print_of(found: np.ndarray) -> int:
    """64-bit SimHash of a set, as a signed number: a bit is set if it is set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(found), CHUNK):
        votes += np.unpackbits(found[lo : lo + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(found)).tobytes(), "big", signed=True)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One key for each band: its number, then the band's bytes."""
    raw = sketch.reshape(-1, ROWS).astype(np.int64)
    return raw @ (1 << (8 * np.arange(ROWS))) + (np.arange(len(raw)) << 8 * ROWS)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, node, size (distinct shingles), keys, sketch and fp (fingerprint) of every row."""

    def run(batches):
        for b in batches:
            nodes, keys, sizes, sketches, prints = [], [], [], [], []
            for x in b.column(1).cast(pa.large_binary()):
                words = words_of(x.as_py() or b"")
                found = shingles(words)
                sketch = sketch_of(found)
                nodes.append(node_of(words))
                keys.append(band_keys(sketch))
                sizes.append(len(found))
                sketches.append(sketch.tobytes())
                prints.append(print_of(found))
            columns = [b.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "size", "keys", "sketch", "fp"])

    return _texts(docs).mapInArrow(run, "doc_id long, node binary, size long, keys array<long>, sketch binary, fp long")


def _close(prints: DataFrame, search: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints ``search`` links; a fingerprint's least node stands for it and is paired
    with its others."""
    nodes = written(prints.select("fp", "node").distinct(), "print-nodes")
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("held")), "prints")
    links = written(search(least.select("fp"), least.count()), "print-links")
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node")) for c in ("a", "b")]
    far = links.join(ends[0], "a").join(ends[1], "b").select(F.greatest("a_node", "b_node").alias("a"), F.least("a_node", "b_node").alias("b"))
    same = join_groups(nodes, least.where("held > 1"), "fp", "held", nodes.count()).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return written(far.unionByName(same).distinct(), "print-pairs")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _suspected(docs: DataFrame, prints: DataFrame, suspects: DataFrame) -> DataFrame:
    """doc_id and text of the rows that may be the first of their words in ``suspects``, without moving a text.

    The least ids of the words in question set bits of a filter of ID_BITS for each, FILTER_BITS at most, sent to the
    texts; all rows without an id share a bit.  A row that passes by chance costs room, no result: the join on the words
    is exact.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(min(FILTER_BITS, 1 << (ID_BITS * suspects.count()).bit_length())))
    ids = prints.join(suspects.select("node"), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    bits = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = _texts(docs).withColumn("bucket", F.bitmap_bucket_number(bit))
    found = rows.join(F.broadcast(written(bits, "suspect-bits")), "bucket")
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select("doc_id", "text")


def _words(docs: DataFrame) -> DataFrame:
    """node and words (normalised, joined by one space) of every row, once for each task."""

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            nodes, joined = [], []
            for x in b.column(1).cast(pa.large_binary()):  # one text's words at a time, as they take many times its room
                words = words_of(x.as_py() or b"")
                node = node_of(words)
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    joined.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(joined, pa.binary())], names=["node", "words"])

    return _texts(docs).mapInArrow(run, "node binary, words binary")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar: b's words head each run of the words that are held against them."""

    def run(batches):
        right = None
        for batch in batches:
            a, b = [], []
            for head, node, star, words in zip(*(batch.column(i) for i in (2, 3, 0, 4)), strict=True):
                found = shingles(words.as_py().split())
                if head.as_py():
                    right = found
                elif similar(right, found):
                    a.append(node.as_py())
                    b.append(star.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    held = written(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("held")), "pair-counts")
    parts = F.ceil(F.col("held") / RUN).cast("int")
    stars = held.join(texts.withColumnRenamed("node", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("head"), F.lit(None).cast("binary").alias("node"), "words")
    dealt = join_groups(pairs, held, "b", "held", pairs.count()).select("a", "b", F.pmod(F.xxhash64("a"), parts).cast("int").alias("part"))
    others = dealt.join(texts.withColumnRenamed("node", "a"), "a").select("b", "part", F.lit(False).alias("head"), F.col("a").alias("node"), "words")
    rows = stars.unionByName(others).repartition(numbered_partitions(pairs.sparkSession), "b", "part")
    return rows.sortWithinPartitions("b", "part", F.desc("head")).mapInArrow(run, "a binary, b binary")


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different roots within each run of (key, part); with sides, only from one side to the other."""

    def links(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        up: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while x in up:
                x = up[x]
            return x

        out = []
        sketch = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1)
        sides = np.array([r[2] for r in rows])
        sets: dict[int, np.ndarray] = {}
        band = rows[0][0] >> 8 * ROWS
        for i, x in enumerate(rows):
            equal = sketch[:i] == sketch[i]
            may = np.flatnonzero((equal.sum(axis=1) >= BANDS * ROWS - SKETCH_BITS) & ((sides[:i] == 0) | (sides[:i] != sides[i])))
            first = equal[may].reshape(len(may), BANDS, ROWS).all(axis=2).argmax(axis=1)
            for j in may[first == band].tolist():
                y = rows[j]
                r, s = top(x[4]), top(y[4])
                if r == s:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = shingles(rows[k][6].split())
                if similar(sets[i], sets[j]):
                    up[r] = s
                    out.append((x[3], y[3]))
        return out

    def emit(rows):
        found = links(rows)
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:2] != row[:2]:
                yield emit(held)
                held = []
            held.append(row)
    if held:
        yield emit(held)


def _remaining(members: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """Links between the roots of each bucket (rows of key, node, root), every pair of blocks in a task of its own.

    The steps are tables of their own: as one plan, each join of hot and other groups doubles all that stands below it.
    A text in many blocks is dealt out once for RUN of them; no text goes through the driver.
    """
    sizes = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("held")), "bucket-sizes")
    blocks = F.ceil(F.col("held") / block).cast("int")
    rows = (
        join_groups(members, sizes, "key", "held", members.count())
        .select("key", "node", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(
            "key",
            (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).cast("int").alias("part"),
            F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
            "node",
            "root",
        )
    )
    rows = written(rows, "block-members")
    held = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("held")), "member-counts")
    copies = F.ceil(F.col("held") / RUN).cast("int")
    copied = held.join(texts, "node").select("node", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), "sketch", "words")
    placed = join_groups(rows, held, "node", "held", rows.count()).withColumn("copy", F.pmod(F.xxhash64("key", "part"), copies).cast("int"))
    full = placed.join(copied, ["node", "copy"]).select("key", "part", "side", "node", "root", "sketch", "words")
    dealt = full.repartition(numbered_partitions(members.sparkSession), "key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(_bucket_links, "a binary, b binary")


def similar_components(docs: DataFrame, stars: int = STARS, block: int = BLOCK, search: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """doc_id, node (of the text's words) and root (one for each component) of every row.

    search gives the links (a, b) among a number of distinct fingerprints (column fp), for the candidates that come first.
    """
    prints = written(_sketches(docs), "sketches")
    keys = prints.select("node", "size", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("held")).where("low <> high")
    shared = written(shared.select("key", "held"), "shared-keys")
    members = written(_salted(keys, shared, prints.count() * BANDS).select("key", "node", "size", "held").distinct(), "buckets")
    suspects = written(members.groupBy("node").agg(F.sum("held").alias("mates")), "suspects")
    sketches = written(prints.select("node", "sketch").join(suspects.select("node"), "node", "left_semi").distinct(), "suspect-sketches")
    close = None if search is None else _close(prints, search)
    wanted = suspects.select("node")
    if close is not None:
        wanted = written(wanted.unionByName(close.select(F.col("a").alias("node"))).unionByName(close.select(F.col("b").alias("node"))).distinct(), "wanted")
    words = _words(_suspected(docs, prints, wanted)).join(wanted, "node", "left_semi").groupBy("node").agg(F.first("words").alias("words"))
    texts = written(words, "suspect-words")

    left = members.join(suspects, "node").select("key", "node", "size", "mates", F.col("node").alias("root"))
    if close is None:
        links, left = None, written(left, "open-buckets")
    else:
        links = written(_verified(close, texts).withColumn("turn", F.lit(-1)), "close-links")
        left = _open(left, links)
    turn, opened, before = 0, left.count(), None
    while opened:
        starred = turn < stars or (turn and opened * 2 <= before)
        if starred:
            order = F.struct(-F.col("mates") if not turn else F.xxhash64("node", F.lit(turn)), "node")
            first = left.groupBy("key").agg(F.min(F.struct(order.alias("order"), "node", "root", "size")).alias("first"), F.count(F.lit(1)).alias("held"))
            joined = written(join_groups(left, written(first, "first"), "key", "held", opened).where(F.col("node") != F.col("first.node")), "stars")
            fits = F.least("size", "first.size") >= F.greatest("size", "first.size") * SIMILAR
            pairs = joined.where(F.col("root") != F.col("first.root")).where(fits).select(F.col("node").alias("a"), F.col("first.node").alias("b")).distinct()
            found = _verified(written(pairs, "near-pairs"), texts)
        else:
            found = _remaining(left.select("key", "node", "root"), texts.join(sketches, "node"), block)
        found = written(found.withColumn("turn", F.lit(turn)), "near-links")
        links = found if links is None else links.unionByName(found)
        if not starred:
            break
        # the first has met all others of its bucket, so it is done there
        left = _open(joined, links)
        turn, before, opened = turn + 1, opened, left.count()
    rows = prints.select("doc_id", "node")
    return rows.withColumn("root", F.col("node")) if links is None else _placed(rows, written(components(links), "near-roots"))


def _open(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (key, node, size, mates) of buckets with several roots; texts linked to one text need not meet."""
    groups = links.groupBy("a").agg(F.min(F.struct("turn", "b")).alias("to")).select(F.col("a").alias("node"), "to.b")
    placed = rows.join(groups, "node", "left").select("key", "node", "size", "mates", F.coalesce("b", "node").alias("root"))
    placed = written(placed, "placed-buckets")
    open_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("held")).where("low <> high").select("key", "held")
    found = join_groups(placed, written(open_keys, "open-keys"), "key", "held", max(1, placed.count()))
    return written(found.select("key", "node", "size", "mates", "root"), "open-buckets")


def _salted(keys: DataFrame, shared: DataFrame, total: int) -> DataFrame:
    """Join of ``keys`` with ``shared`` on the key.  Those of over 1/HOT_SHARE of all rows, fewer than HOT_SHARE, are
    dealt out over SALTS; the plan is the same however many there are."""
    hot = [r["key"] for r in shared.where(F.col("held") * HOT_SHARE > total).select("key").collect()]
    spread = F.col("key").isin(hot) if hot else F.lit(False)
    salt = F.when(spread, F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(spread, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return keys.withColumn("salt", salt).join(shared.withColumn("salt", F.explode(salts)), ["key", "salt"])


def _placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of each node (itself where it has no link)."""
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("held")).join(roots, "node", "left")
    groups = written(counts.select("node", "held", F.coalesce("root", "node").alias("root")), "placed")
    return join_groups(rows, groups, "node", "held", rows.count()).drop("held")
