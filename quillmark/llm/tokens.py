"""Bulk tokenisation with the ``tokenizers`` library.

A text is cut only where the pre-tokeniser cuts it anyway (next to white space), every distinct piece of a batch
is encoded once, and the ids are gathered back in order.  The result is what the library gives for the whole text;
texts whose white space leaves no such cut are given to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode white space and the separators that Python also counts as space.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Text bytes handled at once, and entries kept between batches.  Both bound a worker's memory only.
SLICE_BYTES = 6 << 20
CACHE_ENTRIES = 200_000
LONGEST_CACHED = 40
#: Pieces that are encoded as one text.
RUN_PIECES = 256

_loaded: dict[str, BulkEncoder] = {}


def encoder(path: str) -> BulkEncoder:
    """The worker's encoder for a tokenizer file; loaded once."""
    if path not in _loaded:
        _loaded[path] = BulkEncoder(path)
    return _loaded[path]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (a longer text stands alone)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, len(texts)
    while start < n:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield start, min(end, n)
        start = end


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every range, one range after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class BulkEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.model._resize_cache(0)  # pieces are cached here instead
        with open(path) as f:
            spec = json.load(f)
        self.style = self._style(spec)
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"])}
        self.mark, self.mark_id = next(iter(sorted(specials.items())), (None, None))
        self.specials = sorted(specials)
        if self.mark is None or any(t["content"] not in specials for t in spec.get("added_tokens", [])):
            self.style = "whole"
        self.cache: dict[str, bytes] = {}
        # bytes of text that each id stands for, in a byte-level vocabulary (a character for each byte)
        suffix = spec.get("model", {}).get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.id_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.id_bytes[i] = len(token.removesuffix(suffix) if suffix else token)

    @staticmethod
    def _style(spec: dict) -> str:
        """Where white space lets a text be cut: 'dropped', 'prefixed' (one space joins the next word) or 'whole'."""
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "prefixed"
        parts = pre.get("pretokenizers", [])
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        if set(steps) <= {"NFC", "Replace", "Lowercase"} and parts and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and r"[^\s\p{L}\p{N}]+" in parts[0].get("pattern", {}).get("Regex", ""):
            return "dropped"
        return "whole"

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, pieces: list[str]) -> list[bytes] | None:
        """Ids of every piece from ordinary text that holds them all, cut where the bytes of the ids reach those of the
        pieces; None if some cut is not met (the normaliser changed a length)."""
        joiner = " " if self.style == "dropped" else ""
        found = self.tokenizer.encode_batch_fast([joiner.join(pieces[i : i + RUN_PIECES]) for i in range(0, len(pieces), RUN_PIECES)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in found])
        if len(ids) and int(ids.max()) >= len(self.id_bytes):
            return None
        reached = np.cumsum(self.id_bytes[ids])
        wanted = np.cumsum(np.fromiter(map(len, map(str.encode, pieces)), np.int64, len(pieces)))
        cut = np.searchsorted(reached, wanted) + 1
        if not len(ids) or cut[-1] != len(ids) or not np.array_equal(reached[cut - 1], wanted):
            return None
        raw, ends = ids.tobytes(), (cut * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of every piece: of most in runs of text, of the others apart."""
        lead = " \n" if self.style == "prefixed" else ""
        fit = [bool(x) and (not lead or (x[0] in lead and len(x) > 1)) and not any(s in x for s in self.specials) for x in pieces]
        inner = [x for x, ok in zip(pieces, fit, strict=True) if ok]
        if not inner or (out := self._run(inner)) is None:
            return self._apart(pieces)
        rest = iter(self._apart([x for x, ok in zip(pieces, fit, strict=True) if not ok]))
        ready = iter(out)
        return [next(ready) if ok else next(rest) for ok in fit]

    def _apart(self, pieces: list[str]) -> list[bytes]:
        """Ids of every piece, all in one call: a special token between two pieces keeps them apart."""
        odd = [i for i, x in enumerate(pieces) if any(s in x for s in self.specials)]
        plain = pieces if not odd else [x for i, x in enumerate(pieces) if i not in set(odd)]
        out: list[bytes] = []
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(plain)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(ids == self.mark_id)
            raw = ids.tobytes()
            out = [raw[a:b] for a, b in zip([0, *((cut + 1) * 4).tolist()], [*(cut * 4).tolist(), len(raw)], strict=True)]
        if odd:
            rest, whole, odd_set = iter(out), iter(self._whole([pieces[i] for i in odd])), set(odd)
            out = [next(whole) if i in odd_set else next(rest) for i in range(len(pieces))]
        return out

    def _lookup(self, keys: list[str]) -> list[bytes]:
        found = list(map(self.cache.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        for lo in range(0, len(missing), 20_000):
            part = missing[lo : lo + 20_000]
            for i, ids in zip(part, self._pieces([keys[i] for i in part]), strict=True):
                found[i] = ids
                if len(self.cache) < CACHE_ENTRIES and len(keys[i]) <= LONGEST_CACHED:
                    self.cache[keys[i]] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids of each.  A null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.style == "whole" or not len(texts):
            return self._joined(self._whole(texts.to_pylist()))
        if self.style == "dropped":  # A-Z are lower-cased by the normaliser in any case
            ready = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
            odd = np.logical_or.reduce([pc.match_substring(ready, x).to_numpy(zero_copy_only=False) for x in self.specials])
        else:
            ready = pc.replace_substring(texts, "\n", " \n")
            odd = pc.match_substring_regex(texts, f"^{SPACE}|{SPACE}$|{SPACE}{SPACE}").to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._cut(ready)
        plain, n_plain = self._cut(ready.filter(pa.array(~odd)))
        other, n_other = self._joined(self._whole(texts.filter(pa.array(odd)).to_pylist()))
        counts = np.empty(len(texts), np.int64)
        counts[~odd], counts[odd] = n_plain, n_other
        starts = np.empty(len(texts), np.int64)
        starts[~odd] = np.cumsum(n_plain) - n_plain
        starts[odd] = len(plain) + np.cumsum(n_other) - n_other
        return np.concatenate([plain, other])[gather(starts, counts)], counts

    @staticmethod
    def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) // 4

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        keys, index = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        if self.style == "prefixed":  # all but the first piece of a text carry the space before it
            firsts = offsets[:-1]
            heads = sorted({keys[i] for i in index[firsts].tolist()})
            at = {x: len(keys) + i for i, x in enumerate(heads)}
            index[firsts] = [at[keys[i]] for i in index[firsts].tolist()]
            keys = [x if x[:1] == "\n" else " " + x for x in keys] + heads
        parts = self._lookup(keys)
        flat, sizes = self._joined(parts)
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[index]
        ids = flat[gather(starts[index], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        return ids, np.diff(ends)

    def batches(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, counts) over slices of bounded size."""
        for lo, hi in slices(texts):
            ids, counts = self.encode(texts.slice(lo, hi - lo))
            yield lo, hi, ids, counts


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to the ids of every document."""
    ends = np.cumsum(counts)
    return np.insert(ids, ends, end_id).astype("<u4"), counts + 1
