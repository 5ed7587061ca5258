"""SentencePiece (BPE) encoding by suffix-array matching, and decoding.

The distinct words of a batch stand one after another in one text, whose suffixes are sorted (as far as the longest
piece goes).  Every piece of the model is looked up by binary search: its range of suffixes is where it occurs.  The
occurrences are edges from start to end; sorted by end position, they are relaxed: an edge is taken if the token that
ends where it starts is reachable and may stand before it.  Two tokens may stand side by side if undoing their merges,
latest first, never passes a pair that would have merged earlier; for byte-pair merges exactly one edge into each
position passes this test, so the path is the one that merging gives.

No piece but runs of the word mark holds a mark after another character, so words are independent; runs of more than
one mark are merged on their own, left to right.  Characters without a piece become byte pieces.

Nulls: a null text is empty and has no ids; null doc_ids are kept.  Repeated rows each have their ids.  An empty table
gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import crc_of, table
from quillmark.llm.tokens import CACHE_ENTRIES, LONGEST_CACHED, gather, slices

MARK = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
NEVER = np.int64(1) << 40
#: Characters of the concatenated words that are matched at once.
MATCHED = 1 << 20
BLOCK = 4  # characters in one 64-bit key


class Model:
    """Tables of a SentencePiece BPE model with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if kind != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces and proto.trainer_spec.byte_fallback):
            raise ValueError("only BPE models with identity normalisation, a dummy prefix and byte fallback are supported")
        self.n = len(proto.pieces)
        self.bytes_of = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.decoded = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() if p.type == NORMAL else " ⁇ ".encode() if p.type == UNKNOWN else b"" for p in proto.pieces]
        own = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.runs = {len(p): i for p, (i, _) in own.items() if set(p) == {MARK}}
        words = {p: v for p, v in own.items() if MARK not in p[1:]}
        if len(own) != len(words) + len(self.runs) - (1 in self.runs):
            raise ValueError("a piece holds a word mark after another character")
        # the order of merges: higher scores first; a single character is no merge
        order = sorted((p for p in words if len(p) > 1), key=lambda p: -words[p][1])
        self.time = np.full(self.n + 1, -1, np.int64)
        self.left, self.right = np.zeros(self.n + 1, np.int64), np.zeros(self.n + 1, np.int64)
        pairs: dict[tuple[int, int], int] = {}
        kept = [p for p in words if len(p) == 1]
        for rank, p in enumerate(order):
            parts = [words[c][0] if c in words else -1 for c in p]
            while len(parts) > 2:
                best, at = min((pairs.get((a, b), rank), i) for i, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)))
                if best >= rank:
                    break
                parts[at : at + 2] = [words[order[best]][0]]
            if len(parts) == 2 and min(parts) >= 0 and tuple(parts) not in pairs:
                i = words[p][0]
                self.time[i], self.left[i], self.right[i] = rank, *parts
                pairs[tuple(parts)] = rank
                kept.append(p)
        keys = sorted((a * (self.n + 1) + b, r) for (a, b), r in pairs.items())
        self.pair_keys, self.pair_times = (np.array(x, np.int64) for x in zip(*keys, strict=True))
        # characters of the pieces, numbered from 2 in order; 0 is the end of the text and 1 any other character
        chars = sorted({c for p in kept for c in p})
        self.char = np.array([ord(c) for c in chars], np.uint32)
        number = {c: i + 2 for i, c in enumerate(chars)}
        kept.sort(key=lambda p: [number[c] for c in p])
        self.longest = max(map(len, kept))
        self.blocks = -(-self.longest // BLOCK)
        self.piece = np.array([words[p][0] for p in kept], np.int64)
        self.size = np.array([len(p) for p in kept], np.int64)
        codes = np.zeros((len(kept), self.blocks * BLOCK), np.uint64)
        for i, p in enumerate(kept):
            codes[i, : len(p)] = [number[c] for c in p]
        self.key = sum(codes.reshape(len(kept), self.blocks, BLOCK)[:, :, k] << np.uint64(16 * (BLOCK - 1 - k)) for k in range(BLOCK))
        held = np.clip(self.size[:, None] - BLOCK * np.arange(self.blocks)[None], 0, BLOCK)
        self.mask = np.array([0] + [(2**64 - 1) << (16 * (BLOCK - k)) & (2**64 - 1) for k in range(1, BLOCK + 1)], np.uint64)[held]

    def may_meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging would leave the tokens a and b side by side."""
        out = np.ones(len(a), bool)
        rows = np.arange(len(a))
        limit = np.full(len(a), NEVER)
        while len(rows):
            keys = a * (self.n + 1) + b
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            merged = np.where(self.pair_keys[at] == keys, self.pair_times[at], NEVER)
            bad = merged < limit
            out[rows[bad]] = False
            ta, tb = self.time[a], self.time[b]
            go = ~bad & ((ta >= 0) | (tb >= 0))
            rows, a, b, ta, tb = rows[go], a[go], b[go], ta[go], tb[go]
            undo_a = ta > tb  # of equal merges the left one comes first, so the right one is undone first
            limit = np.where(undo_a, ta, tb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out


def suffix_order(codes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``blocks * BLOCK`` characters, and the key of each position's next ``BLOCK``."""
    n = len(codes)
    wide = np.concatenate([codes, np.zeros(blocks * BLOCK * 2, np.uint64)])
    keys = sum(wide[k : len(wide) - BLOCK + k + 1] << np.uint64(16 * (BLOCK - 1 - k)) for k in range(BLOCK))
    _, rank = np.unique(keys[:n], return_inverse=True)
    reach = BLOCK
    order = np.argsort(rank, kind="stable")
    while reach < blocks * BLOCK:  # prefix doubling
        after = np.zeros(n, np.int64)
        after[: max(0, n - reach)] = rank[reach:] + 1
        both = rank.astype(np.int64) * (n + 2) + after
        order = np.argsort(both, kind="stable")
        own = both[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]]))
        reach *= 2
    return order, keys


def occurrences(model: Model, order: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every piece, the range of the suffix order where it occurs: binary search for all pieces at once."""
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(len(model.piece), np.int64), np.full(len(model.piece), len(order))
        while (open_ := lo < hi).any():
            rows = np.flatnonzero(open_)
            mid = (lo[rows] + hi[rows]) >> 1
            less, same = np.zeros(len(rows), bool), np.ones(len(rows), bool)
            for k in range(model.blocks):
                own = keys[order[mid] + BLOCK * k] & model.mask[rows, k]
                less |= same & (own < model.key[rows, k])
                same &= own == model.key[rows, k]
            right = less | same if upper else less
            lo[rows[right]] = mid[right] + 1
            hi[rows[~right]] = mid[~right]
        bounds.append(lo)
    return bounds[0], bounds[1]


def match(model: Model, words: list[str]) -> list[bytes]:
    """Ids (little-endian 32-bit) of every word, each with its mark before it; a word holds no mark."""
    text = MARK + MARK.join(words)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.minimum(np.searchsorted(model.char, points), len(model.char) - 1)
    codes = np.where(model.char[at] == points, at + 2, 1).astype(np.uint64)
    starts = np.flatnonzero(points == ord(MARK))
    sizes = np.diff(np.append(starts, len(points)))
    order, keys = suffix_order(codes, model.blocks)
    lo, hi = occurrences(model, order, keys)
    count = hi - lo
    begin = order[gather(lo, count)]
    index = np.repeat(np.arange(len(count)), count)
    strange = np.flatnonzero(codes == 1)  # a character without a piece is an edge of its own
    begin = np.concatenate([begin, strange])
    piece = np.concatenate([model.piece[index], np.full(len(strange), model.n)])
    length = np.concatenate([model.size[index], np.ones(len(strange), np.int64)])
    word = np.repeat(np.arange(len(words)), sizes)
    inside = word[begin] == word[np.minimum(begin + length - 1, len(points) - 1)]
    begin, piece, length = begin[inside], piece[inside], length[inside]
    end = begin + length  # the end of one word is the start of the next: positions count from 1
    local = end - starts[word[begin]]
    # one sort of packed keys: the end position (in order of its distance from the word's start), then longest first
    way = np.arange(1, len(points) + 1) - np.repeat(starts, sizes)
    turn = np.empty(len(points) + 1, np.int64)
    turn[np.argsort(way, kind="stable") + 1] = np.arange(len(points))
    by_end = np.sort(turn[end] << 37 | (31 - length) << 32 | np.arange(len(end))) & 0xFFFFFFFF
    begin, piece, length, end, local = (x[by_end] for x in (begin, piece, length, end, local))
    heads = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
    groups = np.diff(np.append(heads, len(end)))
    steps = np.searchsorted(local[heads], np.arange(1, int(sizes.max(initial=0)) + 2))
    token = np.full(len(points) + 1, -1, np.int64)
    token_size = np.ones(len(points) + 1, np.int64)
    first = np.zeros(len(points) + 1, bool)
    first[starts] = True
    for s in range(len(steps) - 1):
        todo, left = heads[steps[s] : steps[s + 1]], groups[steps[s] : steps[s + 1]]
        while len(todo):
            ok = first[begin[todo]]
            rest = np.flatnonzero(~ok)
            ok[rest] = model.may_meet(token[begin[todo[rest]]], piece[todo[rest]])
            done = todo[ok]
            token[end[done]], token_size[end[done]] = piece[done], length[done]
            more = ~ok & (left > 1)
            todo, left = todo[more] + 1, left[more] - 1
    # back along the paths, all words at a time
    place = starts + sizes
    rows, found, ends = np.arange(len(words)), [], []
    n_tokens = np.zeros(len(words), np.int64)
    while len(rows):
        found.append((rows, token[place]))
        ends.append(place)
        n_tokens[rows] += 1
        place = place - token_size[place]
        go = place > starts[rows]
        rows, place = rows[go], place[go]
    base = np.cumsum(n_tokens) - n_tokens
    flat, spot = np.empty(int(n_tokens.sum()), np.int64), np.empty(int(n_tokens.sum()), np.int64)
    for k, ((rows, tokens_), e) in enumerate(zip(found, ends, strict=True)):
        to = base[rows] + n_tokens[rows] - 1 - k
        flat[to], spot[to] = tokens_, e - 1
    raw = flat.astype("<u4").tobytes()
    out = [raw[4 * a : 4 * b] for a, b in zip(base.tolist(), (base + n_tokens).tolist(), strict=True)]
    for w in np.unique(np.repeat(np.arange(len(words)), n_tokens)[flat == model.n]).tolist():
        ids: list[int] = []
        for i in range(int(base[w]), int(base[w] + n_tokens[w])):
            ids += [int(flat[i])] if flat[i] < model.n else [model.bytes_of[x] for x in chr(int(points[spot[i]])).encode("utf-8", "surrogatepass")]
        out[w] = np.array(ids, "<u4").tobytes()
    return out


class PieceEncoder:
    """Encodes Arrow arrays of texts; distinct words are matched once, and frequent ones are kept between batches."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}
        self.mark = np.array([model.runs[1]], "<u4").tobytes()

    def run(self, n: int) -> bytes:
        """Ids of a run of n marks: all merges of marks rank alike, so the leftmost pair with a piece merges first."""
        out: list[int] = []
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in self.model.runs:
                out[-2:] = [out[-2] + out[-1]]
        return np.array([self.model.runs[k] for k in out], "<u4").tobytes()

    def lookup(self, words: list[str]) -> list[bytes]:
        found = [self.cache.get(w) for w in words]
        missing = [i for i, x in enumerate(found) if x is None]
        lo = 0
        while lo < len(missing):
            hi, size = lo, 0
            while hi < len(missing) and (hi == lo or size + len(words[missing[hi]]) < MATCHED):
                size += len(words[missing[hi]]) + 1
                hi += 1
            for i, ids in zip(missing[lo:hi], match(self.model, [words[i] for i in missing[lo:hi]]), strict=True):
                found[i] = ids
                if len(self.cache) < CACHE_ENTRIES and len(words[i]) <= LONGEST_CACHED:
                    self.cache[words[i]] = ids
            lo = hi
        return found

    def spaced(self, text: str) -> bytes:
        """Ids of a text with runs of spaces, or one at an end."""
        units = re.findall(r"( +)([^ ]*)", " " + text)
        ids = dict(zip(words := sorted({w for _, w in units if w}), self.lookup(words), strict=True))
        out = []
        for spaces, word in units:
            own = ids[word] if word else self.mark
            if own[:4] == self.mark:  # the mark stayed alone, so it merges with those before it
                out += [self.run(len(spaces)), own[4:]]
            else:
                out += [self.run(len(spaces) - 1), own]
        return b"".join(out)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids of each."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
        odd = pc.match_substring_regex(texts, "^$|^ | $|  ").to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        parts = self.lookup(coded.dictionary.to_pylist())
        flat, sizes = np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        index = coded.indices.to_numpy().astype(np.int64)
        ids = flat[gather((np.cumsum(sizes) - sizes)[index], sizes[index])]
        ends = np.concatenate([[0], np.cumsum(sizes[index])])[offsets - offsets[0]]
        if not odd.any():
            return ids, np.diff(ends)
        other = [self.spaced(x) if x else b"" for x in texts.filter(pa.array(odd)).to_pylist()]
        counts, begin = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        counts[~odd], begin[~odd] = np.diff(ends), ends[:-1]
        counts[odd] = np.fromiter(map(len, other), np.int64, len(other)) // 4
        begin[odd] = len(ids) + np.cumsum(counts[odd]) - counts[odd]
        return np.concatenate([ids, np.frombuffer(b"".join(other), "<u4")])[gather(begin, counts)], counts

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: the mark before the first word is dropped; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.model.decoded.__getitem__, ids.tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    return Model(path)


_encoders: dict[str, PieceEncoder] = {}


def worker_encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(model_of(path))
    return _encoders[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of int) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(1)):
                ids, counts = worker_encoder(model).encode(b.column(1).slice(lo, hi - lo))
                ends = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [worker_encoder(model).decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Encode every text, decode the ids again, and return for each row: doc_id, n_tokens, ids_crc32 (unsigned, ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded text) and round_trip (it is the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_encoder(model)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                texts = b.column(1).slice(lo, hi - lo)
                ids, counts = coder.encode(texts)
                crc, sha, same = [], [], []
                begin = 0
                for n, text in zip(counts.tolist(), texts, strict=True):
                    own = ids[begin : begin + n]
                    begin += n
                    back = coder.decode(own)
                    crc.append(crc_of(own))
                    sha.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    same.append(back == (text.as_py() or ""))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(counts), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
