"""Best-fit packing of documents into sequences by exact-complement hashing.

The plan works on the histogram of piece lengths, which has at most ``size`` entries however many pieces there are.
Longest first, each length looks up what fills its gap exactly: a single length, a pair in the index of pair sums,
then a triple in the index of triple sums (``SumIndex``).  A combination is consumed as often as the counts of its lengths allow.
What has no exact complement left is placed by best fit, longest first, into the smallest gap that takes it.

A plan is a list of patterns with a count each.  Every piece has a rank among the pieces of its length (its rank within
the writing task plus the pieces of that length in the tasks before), and the rank says which sequence of which pattern
it belongs to, so pieces are placed without being brought together.

Nulls: a null text is empty: its document is the end id alone.  A null doc_id is kept as it is.  Repeated rows are
packed each on their own.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import crc_of, table, written

RANKS = 1 << 40  # more pieces of one length than this would not fit a plan's keys


class SumIndex:
    """Sums of one, two and three available lengths by hash: what fills a gap exactly is looked up under the gap.

    ``pairs`` has the larger length of each pair under the pair's sum, ``triples`` the largest length of each triple
    under the triple's sum, whose other two are then in ``pairs`` under what is left; both largest first.  Counts only
    ever fall, so an entry that they do not allow any more is taken out where it is met.
    """

    def __init__(self, counts: np.ndarray, most: int):
        self.counts = counts
        self.size = len(counts) - 1
        self.pairs: dict[int, list[int]] = {}
        self.triples: dict[int, list[int]] = {}
        lengths = np.flatnonzero(counts)[::-1].tolist()
        for a in lengths if most > 1 else ():
            for b in lengths:
                if b <= a and a + b < self.size and (b < a or counts[a] > 1):
                    self.pairs.setdefault(a + b, []).append(a)
        for a in lengths if most > 2 else ():
            for total in self.pairs:
                if a + total < self.size and self.pairs[total][-1] <= a:
                    self.triples.setdefault(a + total, []).append(a)

    def times(self, combo: tuple[int, ...]) -> int:
        """How often the counts allow a combination."""
        return min(int(self.counts[x]) // combo.count(x) for x in set(combo))

    def of_two(self, total: int, at_most: int) -> Iterator[tuple[int, int]]:
        entry = self.pairs.get(total, [])
        if any(not (self.counts[a] and self.counts[total - a]) for a in entry):
            entry = self.pairs[total] = [a for a in entry if self.counts[a] and self.counts[total - a]]
        for a in entry:
            if a <= at_most and self.counts[a] and self.counts[total - a]:
                yield a, total - a

    def fills(self, length: int) -> Iterator[tuple[int, ...]]:
        """Combinations of ``length`` and others that sum to the size exactly, fewest lengths first."""
        gap = self.size - length
        if not gap:
            yield (length,)
            return
        if self.counts[gap]:
            yield length, gap
        for a, b in self.of_two(gap, gap):
            yield length, a, b
        entry = self.triples.get(gap, [])
        if any(not self.counts[a] for a in entry):
            entry = self.triples[gap] = [a for a in entry if self.counts[a]]
        for a in entry:
            for b, c in self.of_two(gap - a, a):
                if self.counts[a]:
                    yield length, a, b, c


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths) and how many sequences have each; counts[n] pieces have length n.

    Exact fills by many short lengths can leave long ones without a partner, so plans with up to three, two and one
    lengths in a gap are made, and the one of fewest sequences is taken (the histogram is small, however much there is).
    """
    return min((_plan(counts, most) for most in (3, 2, 1)), key=lambda p: sum(n for _, n in p))


def _plan(counts: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    counts = np.array(counts, np.int64)
    size = len(counts) - 1
    index, out, rest = SumIndex(counts, most), [], np.zeros(size + 1, np.int64)
    for length in range(size, 0, -1):
        if counts[length]:
            for combo in index.fills(length):
                if n := index.times(combo):
                    out.append((combo, n))
                    for x in combo:
                        counts[x] -= n
                if not counts[length]:
                    break
        rest[length], counts[length] = counts[length], 0
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = np.zeros(size + 1, bool)
    for length in range(size, 0, -1):
        left = int(rest[length])
        while left:
            fits = np.flatnonzero(gaps[length:])
            gap = length + int(fits[0]) if len(fits) else size
            pattern, n = open_bins[gap].pop() if len(fits) else ((), left)
            copies = min(left, gap // length)  # the smallest gap stays the smallest until it is too small
            taken = min(n, left // copies)
            if n > taken and len(fits):
                open_bins[gap].append((pattern, n - taken))
            gaps[gap] = bool(open_bins.get(gap))
            left -= taken * copies
            pattern, gap = (*pattern, *(length,) * copies), gap - copies * length
            if gap:
                open_bins.setdefault(gap, []).append((pattern, taken))
                gaps[gap] = True
            else:
                out.append((pattern, taken))
    return out + [x for bins in open_bins.values() for x in bins]


def slots(patterns: list[tuple[tuple[int, ...], int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and for each the first sequence and the offset in it."""
    used = np.zeros(size + 1, np.int64)
    rows, base = [], 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            rows.append((x * RANKS + int(used[x]), base, offset))
            used[x] += n
            offset += x
        base += n
    keys, first, offsets = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return keys, first, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Pieces of at most ``size`` ids; only a longer document is cut, and only its first piece is shorter.

    task and rank: the writing task, and the rank among its pieces of that length.
    """
    from quillmark.llm.tokens import encoder, with_end

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for lo, hi, ids, counts in encoder(tokenizer).batches(batch.column(1)):
                ids, counts = with_end(ids, counts, end_id)
                parts = -(-counts // size)
                doc = np.repeat(np.arange(hi - lo), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                head = counts - (parts - 1) * size
                length = np.where(piece == 0, head[doc], size)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * size)
                ends = np.cumsum(length)
                crc = [crc_of(ids[a:b]) for a, b in zip((ends - length).tolist(), ends.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                run_start = np.searchsorted(length[order], length[order])
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - run_start + seen[length[order]]
                seen += np.bincount(length, minlength=size + 1)
                cols = [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(rank)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(docs, tokenizer, end_id, size), "pieces")
    by_task = written(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(size + 1, np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[row["length"]] = row["n"]
    keys, first, offsets = slots(plan(counts), size)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # a key has at most the pieces of one task, so the shuffle is even; the table of ranks grows with the tasks
    ranked = cut.join(ranks.hint("merge"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, length * RANKS + rank, side="right") - 1
            cols = [*b.columns[:5], pa.array(first[at] + rank - keys[at] % RANKS), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
