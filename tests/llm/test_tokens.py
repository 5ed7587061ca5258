import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmark.llm import packing, token_files
from quillmark.llm.common import table
from quillmark.llm.tokens import encoder, slices
from tests.llm.helpers import ODD, SMALL, clashing, documents

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def ids_of(name, text):
    return Tokenizer.from_file(P.path(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_what_whole_texts_give(name):
    coder, whole = encoder(P.path(name)), Tokenizer.from_file(P.path(name))
    assert coder.style != "whole"
    for texts in (ODD, ODD[::-1]):
        ids, counts = coder.encode(pa.array(texts))
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet="aB'sé \n\t\u00a0\u3000.,<|>\u0301日1", max_size=25), min_size=1, max_size=8))
def test_random_texts(name, texts):
    coder = encoder(P.path(name))
    ids, counts = coder.encode(pa.array(texts))
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_slices_cover_all_rows_in_bounded_parts():
    texts = pa.array(["a" * n for n in (1, 50, 3, 0, 200, 1, 1)] + [None])
    parts = list(slices(texts, 60))
    assert parts[0][0] == 0 and parts[-1][1] == 8 and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**16 - 1), st.integers(0, 2**32 - 1)), max_size=2600), st.sampled_from([50, 95, 100]))
def test_blocks_round_trip(values, percentile):
    ids = np.array(values, np.uint32)
    blocks = token_files.encode_blocks(ids, percentile)
    places = np.cumsum([0, *map(len, blocks)])[:-1]
    assert token_files.decode_blocks(b"".join(blocks), places).tolist() == values
    assert len(blocks) == -(-len(values) // token_files.BLOCK)


def test_outliers_do_not_widen_a_block():
    ids = np.full(1024, 7, np.uint32)
    ids[5] = 4_000_000_000
    assert len(token_files.encode_blocks(ids)[0]) < 40


def test_a_file_is_read_from_any_document(tmp_path):
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3000, 200)
    ids = rng.integers(0, 50_000, int(counts.sum())).astype(np.uint32)
    path = tmp_path / "x.pfor"
    with path.open("wb") as f:
        w = token_files.TokenFileWriter(f)
        w.add(pa.array(list(range(199)) + [None], pa.int64()), ids, counts)
        assert w.close() == {"n_docs": 200, "n_ids": len(ids)}
    with path.open("rb") as f:
        r = token_files.TokenFileReader(f, path.stat().st_size)
        assert r.nulls.tolist() == [False] * 199 + [True]
        for d in (0, 7, 199):
            a = int(r.starts[d])
            assert r.ids(a, a + int(r.counts[d])).tolist() == ids[a : a + counts[d]].tolist()
        assert np.concatenate([x for _, _, x in r.documents(5000)]).tolist() == ids.tolist()
    with (tmp_path / "bad").open("wb") as f:
        f.write(b"0" * 40)
    with (tmp_path / "bad").open("rb") as f, pytest.raises(ValueError, match="not a token file"):
        token_files.TokenFileReader(f, 40)


def test_token_files_against_brute_force(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in token_files.op4_token_files(spark, SMALL).collect()}
    start = 0
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        ids = np.array([*ids_of("word_bpe_49k.json", r["text"]), 2], "<u4")
        assert got[r["doc_id"]] == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_token_files_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "twice"), (None, "no id"), (3, "hello world")]
    got = token_files.token_files(clashing(documents(spark, rows)), P.path(FILES[0]), files=5).collect()
    assert len(got) == len(rows)
    first = min(got, key=lambda r: r["start"])
    assert first["doc_id"] is None and sum(r["doc_id"] == 3 for r in got) == 3
    ordered = sorted(got, key=lambda r: r["start"])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:], strict=False))
    assert token_files.token_files(documents(spark, []), P.path(FILES[0])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=17, max_size=17))
def test_plans_use_every_piece_once_and_fit(counts):
    counts[0] = 0
    size = len(counts) - 1
    patterns = packing.plan(np.array(counts))
    used = np.zeros(size + 1, np.int64)
    for lengths, n in patterns:
        assert n > 0 and sum(lengths) <= size
        for x in lengths:
            used[x] += n
    assert used.tolist() == counts
    total = sum(i * c for i, c in enumerate(counts))
    assert sum(n for _, n in patterns) <= 1.5 * max(-(-total // size), sum(counts[size // 2 + 1 :])) + 1


def test_exact_complements_come_first():
    counts = np.zeros(11, np.int64)
    counts[[7, 3, 6, 2, 5, 1]] = [2, 2, 1, 2, 1, 4]
    assert sum(n for _, n in packing.plan(counts)) == -(-int((counts * np.arange(11)).sum()) // 10)


def check_packing(got, docs, size):
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in docs:
        ids = np.array([*ids_of("byte_bpe_50k.json", text), 2], "<u4")
        own = sorted(pieces[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // size)))
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == size for r in own[1:])
        for r in own:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    return len(sequences), -(-sum(r["length"] for r in got) // size)


def test_packing_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    n, least = check_packing(packing.op6_best_fit_packing(spark, SMALL).collect(), docs, 1024)
    assert n <= least + 3


def test_packing_of_odd_rows(spark):
    docs = list(enumerate(ODD))
    check_packing(packing.pack(clashing(documents(spark, docs)).repartition(3), P.path(FILES[1]), 64).collect(), docs, 64)
    repeated = packing.pack(documents(spark, [(1, "same text"), (1, "same text"), (None, "x")]), P.path(FILES[1]), 64).collect()
    assert len(repeated) == 3
    assert packing.pack(documents(spark, []), P.path(FILES[1])).count() == 0
