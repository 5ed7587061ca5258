import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import nearest, pieces
from quillmark.llm.common import table
from tests.llm.helpers import ODD, SMALL, clashing, documents

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]


def test_encoding_is_the_librarys(library):
    coder = pieces.PieceEncoder(pieces.model_of(MODEL))
    texts = ODD + [" " * n + "z" for n in range(40)] + [" " * n for n in range(40)]
    got = split(*coder.encode(pa.array(texts)))
    for text, ids in zip(texts, got, strict=True):
        assert ids == library.encode(text or "")
        assert coder.decode(np.array(ids, np.int64)) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(alphabet="abtheinr sTé\n日梦\U0001f600▁.1", max_size=40), min_size=1, max_size=6))
def test_random_texts_are_the_librarys(library, texts):
    coder = pieces.PieceEncoder(pieces.model_of(MODEL))
    assert split(*coder.encode(pa.array(texts))) == [library.encode(t) for t in texts]


def test_suffixes_are_sorted_and_pieces_found():
    rng = random.Random(3)
    model = pieces.model_of(MODEL)
    text = "".join(rng.choice("▁the in") for _ in range(400))
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    at = np.minimum(np.searchsorted(model.char, points), len(model.char) - 1)
    codes = np.where(model.char[at] == points, at + 2, 1).astype(np.uint64)
    order, keys = pieces.suffix_order(codes, model.blocks)
    shown = [tuple(codes[i : i + 16].tolist()) for i in order.tolist()]
    assert shown == sorted(shown)
    lo, hi = pieces.occurrences(model, order, keys)
    names = {i: model_piece for i, model_piece in enumerate(sentencepiece.SentencePieceProcessor(model_file=MODEL).id_to_piece(model.piece.tolist()))}
    for i in range(0, len(lo), 7):
        want = {j for j in range(len(text)) if text.startswith(names[i], j)}
        assert set(order[lo[i] : hi[i]].tolist()) == want


def test_sentencepiece_query_against_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    for r in pieces.op1_sentencepiece(spark, SMALL).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]])) and r["round_trip"]
        assert r["ids_crc32"] == pieces.crc_of(np.array(library.encode(texts[r["doc_id"]])))


def test_sentencepiece_of_odd_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "hello world")]
    df = clashing(documents(spark, rows))
    coded = pieces.encode(df, MODEL)
    assert sorted(((r["doc_id"], r["ids"]) for r in coded.collect()), key=str) == sorted(((i, library.encode(t or "")) for i, t in rows), key=str)
    back = pieces.decode(coded.unionByName(spark.createDataFrame([(77, None)], coded.schema)), MODEL).collect()
    assert {r["doc_id"]: r["text"] for r in back}[77] == ""
    assert pieces.digests(documents(spark, []), MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="supported"):
        pieces.Model(str(tmp_path / "m"))


# ---------------------------------------------------------------- nearest neighbours


def recall(got, ids, x, queries, k):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r)
    hit = total = 0
    place = {v: i for i, v in enumerate(ids)}
    for q in queries:
        s = x @ x[place[q]]
        want = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        own = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and len(own) == min(k, len(ids) - 1)
        assert all((a["score"], -a["vec_id"]) > (b["score"], -b["vec_id"]) for a, b in zip(own, own[1:], strict=False))
        assert all(np.isclose(r["score"], float(x[place[q]] @ x[place[r["vec_id"]]]), rtol=1e-12, atol=1e-12) for r in own)
        hit += len({r["vec_id"] for r in own} & set(want))
        total += len(want)
    return hit / total


def test_recall_of_the_query(spark):
    for sf in (SMALL, "/root/testdata/sf0.1"):
        rows = table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
        ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
        assert recall(nearest.op3_nearest(spark, sf).collect(), ids, x, ids[ids % 20 == 0].tolist(), 20) >= 0.9


def test_recall_beyond_the_sample(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (30, 16))
    x = (centres[rng.integers(0, 30, 3000)] + rng.normal(0, 0.4, (3000, 16))).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.search(df, df.where("vec_id % 50 = 0"), k=10, sample=800).collect()
    assert recall(got, np.arange(3000), x, range(0, 3000, 50), 10) >= 0.9


def test_large_leaves_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest.search(df, df.where("vec_id % 2 = 0"), k=5).collect()
    assert recall(got, np.arange(400), x, range(0, 400, 2), 5) >= 0.9


def test_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (2, [1.0, 0.0]), (10, [])]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in nearest.search(df, df, k=20).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)]
    assert nearest.search(df.where("false"), df, k=3).count() == 0
    assert nearest.search(df, df.where("false"), k=3).count() == 0


@pytest.mark.parametrize("part", [8192, 16])
def test_repeated_rows_and_ids_cost_no_neighbour(spark, monkeypatch, part):
    monkeypatch.setattr(nearest, "PART", part)
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (60, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x) for _ in range(25)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert recall(nearest.search(df, df, k=20).collect(), np.arange(60), x, range(60), 20) == 1.0
    # an id of several vectors counts once, with its best product; ties go to the smaller id
    twice = spark.createDataFrame([(1, [1.0]), (2, [5.0]), (2, [3.0]), (2, [5.0]), (4, [2.0]), (3, [2.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in nearest.search(twice, twice.where("vec_id = 1"), k=2).collect())
    assert got == [(1, 1, 2, 5.0), (1, 2, 3, 2.0)]
