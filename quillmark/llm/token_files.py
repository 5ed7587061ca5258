"""Token-ID files: patched frame-of-reference blocks.

A file is ``MAGIC``, the blocks, the index and a footer.  A block holds up to ``BLOCK`` ids: the block minimum is
subtracted, the differences are packed at the width that holds ``PERCENTILE`` percent of them, and the others
(outliers) stand in an exception list of positions and values.  The index has the place of every block and, for every
document in order, its id and number of ids, so a reader can seek to any document.

Nulls: a null text is empty; a null doc_id sorts first and comes back null.  Repeated doc_ids keep all their rows, in
order of text.  An empty table gives no file and an empty result.  Other columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import crc_of, fresh_path, numbered_partitions, table

MAGIC = b"QMPFOR01"
BLOCK = 1024
PERCENTILE = 95
HEAD = struct.Struct("<IHHB")  # minimum, ids, exceptions, width
FLUSH_BLOCKS = 256


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width as rows of bytes, most significant bit first."""
    if width == 16:
        return values.astype(">u2").view(np.uint8).reshape(len(values), -1)
    bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(*values.shape, 4), axis=2)[:, :, 32 - width :]
    return np.packbits(bits.reshape(len(values), -1), axis=1)


def unpack(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    """The inverse of ``pack``, for rows of n values."""
    if width == 16:
        return np.ascontiguousarray(raw).view(">u2").astype(np.uint32)
    bits = np.zeros((len(raw), n, 32), np.uint8)
    bits[:, :, 32 - width :] = np.unpackbits(raw, axis=1)[:, : n * width].reshape(len(raw), n, width)
    return np.packbits(bits, axis=2).view(">u4")[:, :, 0].astype(np.uint32)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of the ids; all but the last hold ``BLOCK`` of them."""
    full = len(ids) // BLOCK
    out: list[bytes] = [b""] * full
    for rows, first in ((ids[: full * BLOCK].reshape(full, BLOCK), 0), (ids[full * BLOCK :].reshape(1, -1), full)):
        if not rows.size:
            continue
        out += [b""] * (first + len(rows) - len(out))
        low = rows.min(axis=1).astype(np.uint32)
        delta = rows.astype(np.uint32) - low[:, None]
        at = min(rows.shape[1] - 1, int(np.ceil(rows.shape[1] * percentile / 100)) - 1)
        widths = np.frexp(np.partition(delta, at, axis=1)[:, at].astype(np.float64))[1]  # bit lengths
        for width in np.unique(widths).tolist():
            own = np.flatnonzero(widths == width)
            part = delta[own]
            over = part >> np.uint32(width) > 0 if width < 32 else np.zeros(part.shape, bool)
            raw = pack(np.where(over, 0, part), width) if width else np.zeros((len(own), 0), np.uint8)
            for k, i in enumerate(own.tolist()):
                places = np.flatnonzero(over[k])
                out[first + i] = b"".join((HEAD.pack(int(low[i]), rows.shape[1], len(places), width), raw[k].tobytes(), places.astype("<u2").tobytes(), part[k, places].astype("<u4").tobytes()))
    return out


def decode_blocks(raw: bytes, places: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at ``places`` of ``raw``."""
    heads = [HEAD.unpack_from(raw, p) for p in places.tolist()]
    out = [np.zeros(0, np.uint32)] * len(heads)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (_, n, _, width) in enumerate(heads):
        groups.setdefault((width, n), []).append(i)
    for (width, n), own in groups.items():
        size = (n * width + 7) // 8
        body = np.stack([np.frombuffer(raw, np.uint8, size, places[i] + HEAD.size) for i in own])
        values = unpack(body, width, n) if width else np.zeros((len(own), n), np.uint32)
        for k, i in enumerate(own):
            low, _, extra, _ = heads[i]
            at = int(places[i]) + HEAD.size + size
            values[k, np.frombuffer(raw, "<u2", extra, at)] = np.frombuffer(raw, "<u4", extra, at + 2 * extra)
            values[k] += np.uint32(low)
            out[i] = values[k]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class TokenFileWriter:
    """Writes to an open binary stream; holds ``FLUSH_BLOCKS`` blocks of ids and the document table in memory."""

    def __init__(self, stream):
        self.stream, self.place = stream, 0
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.blocks: list[int] = []
        self.doc_ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self._put(MAGIC)

    def _put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.place += len(raw)

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
        self.counts.append(np.asarray(counts, "<i8"))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= FLUSH_BLOCKS * BLOCK:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for lo in range(0, n, FLUSH_BLOCKS * BLOCK):
            for raw in encode_blocks(ids[lo : min(n, lo + FLUSH_BLOCKS * BLOCK)]):
                self.blocks.append(self.place)
                self._put(raw)
        self.n_ids += n
        self.held, self.n_held = [ids[n:]], len(ids) - n

    def close(self) -> dict:
        self._flush(self.n_held)
        index = self.place
        for parts, kind in ((self.blocks, "<i8"), *((np.concatenate(x) if x else [], k) for x, k in ((self.doc_ids, "<i8"), (self.counts, "<i8"), (self.nulls, "u1")))):
            self._put(np.asarray(parts, kind).tobytes())
        n_docs = sum(map(len, self.counts))
        foot = json.dumps({"index": index, "blocks": len(self.blocks), "docs": n_docs, "ids": self.n_ids, "block": BLOCK}).encode()
        self._put(foot + struct.pack("<I", len(foot)) + MAGIC)
        return {"n_docs": n_docs, "n_ids": self.n_ids}


class TokenFileReader:
    """Reads from a seekable binary stream."""

    def __init__(self, stream, size: int):
        self.stream = stream
        tail = self._at(size - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a token file")
        length = struct.unpack("<I", tail[:4])[0]
        self.foot = json.loads(self._at(size - 12 - length, length))
        n, d, at = self.foot["blocks"], self.foot["docs"], self.foot["index"]
        raw = self._at(at, 8 * n + 17 * d)
        self.blocks = np.append(np.frombuffer(raw, "<i8", n), at)
        self.doc_ids = np.frombuffer(raw, "<i8", d, 8 * n)
        self.counts = np.frombuffer(raw, "<i8", d, 8 * (n + d))
        self.nulls = np.frombuffer(raw, "u1", d, 8 * (n + 2 * d)).astype(bool)
        self.starts = np.cumsum(self.counts) - self.counts

    def _at(self, place: int, size: int) -> bytes:
        self.stream.seek(place)
        return self.stream.read(size)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from position start to end, by seeking to the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        lo, hi = start // self.foot["block"], (end - 1) // self.foot["block"] + 1
        base = int(self.blocks[lo])
        raw = self._at(base, int(self.blocks[hi]) - base)
        return decode_blocks(raw, self.blocks[lo:hi] - base)[start - lo * self.foot["block"] :][: end - start]

    def documents(self, held: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, end document, their ids), about ``held`` ids at a time."""
        n, first = len(self.counts), 0
        ends = self.starts + self.counts
        while first < n:
            last = max(first + 1, int(np.searchsorted(ends, self.starts[first] + held, side="right")))
            last = min(last, n)
            yield first, last, self.ids(int(self.starts[first]), int(ends[last - 1]))
            first = last


def open_store(uri: str):
    """(filesystem, path) of a folder on storage that all machines share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, files: int | None = None) -> DataFrame:
    """Write the ids of every text, ``end_id`` after each, in ascending doc_id order: one file for each range of ids.

    Returns the list of files (file, path, n_docs, n_ids), one row for each; it is read from what the tasks report.
    """
    from quillmark.llm.tokens import encoder, with_end

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, top = open_store(folder)
        part = TaskContext.get().partitionId()
        writer = stream = None
        temporary, final = f"{top}/.{part:06d}-{uuid.uuid4().hex}", f"{top}/part-{part:06d}.pfor"
        for batch in batches:
            texts, doc_ids = batch.column(1), batch.column(0)
            for lo, hi, ids, counts in encoder(tokenizer).batches(texts):
                if writer is None:
                    store.create_dir(top, recursive=True)
                    stream = store.open_output_stream(temporary)
                    writer = TokenFileWriter(stream)
                writer.add(doc_ids.slice(lo, hi - lo), *with_end(ids, counts, end_id))
        if writer is not None:
            total = writer.close()
            stream.close()
            store.move(temporary, final)  # atomic: a task that runs twice leaves one file
            yield pa.RecordBatch.from_pydict({"file": [part], "path": [final], "n_docs": [total["n_docs"]], "n_ids": [total["n_ids"]]})

    files = files or numbered_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, "file long, path string, n_docs long, n_ids long")


def read_token_files(spark: SparkSession, folder: str, manifest: list[tuple[int, str, int, int]]) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                size = store.get_file_info(row["path"]).size
                with store.open_input_file(row["path"]) as stream:
                    reader = TokenFileReader(stream, size)
                    for first, last, ids in reader.documents():
                        bounds = np.append(reader.starts[first:last], reader.starts[last - 1] + reader.counts[last - 1]) - reader.starts[first]
                        own = np.ascontiguousarray(ids, "<u4")
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.doc_ids[first:last], pa.int64(), mask=reader.nulls[first:last]),
                                pa.array(reader.starts[first:last] + row["base"], pa.int64()),
                                pa.array(reader.counts[first:last], pa.int64()),
                                pa.array([crc_of(own[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    rows, base = [], 0
    for _, path, _, n_ids in sorted(manifest):
        rows.append((path, base))
        base += n_ids
    files = spark.createDataFrame(rows, "path string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, files: int | None = None, folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and read every document back from them."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    manifest = [tuple(r) for r in write_token_files(docs, folder, tokenizer, end_id, files).collect()]  # a row for each file
    return read_token_files(spark, folder, manifest)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
