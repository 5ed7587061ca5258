import random

import public_tokenizers as P
import pytest

import corpus_pipeline
from quillmark.llm import language, quality
from quillmark.llm.common import table, written
from tests.llm.test_dedup import normal
from tests.llm.test_near_copies import brute
from tests.llm.test_tokens import check_packing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with planted copies, near copies, poor and wordless documents."""
    top = tmp_path_factory.mktemp("corpus")
    docs = table(spark, "/root/testdata/sf0.01", "documents").where("doc_id < 250").collect()
    rng = random.Random(9)
    rows = [tuple(r) for r in docs]
    clean = [r for r in rows if 80 < len(r[1].split()) < 2000][:20]
    for i, r in enumerate(clean[:8]):
        rows.append((10_000 + i, r[1].upper() if i % 2 else r[1], r[2], "planted", r[4]))
    for i, r in enumerate(clean[8:14]):
        words = r[1].split(" ")
        words[rng.randrange(len(words))] += "x"
        rows.append((20_000 + i, " ".join(words), r[2], "planted", r[4]))
    rows += [(30_000, None, None, None, None), (30_001, "", "en", "s", 0), (30_002, "123 456 !!", "en", "s", 9), (rows[0][0], *rows[0][1:])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    table(spark, "/root/testdata/sf0.01", "labels").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_every_stage_against_brute_force(spark, folder):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "exact_dedup", "near_dedup", "pack"]
    docs = table(spark, folder, "documents")
    every = [(r["doc_id"], r["text"]) for r in docs.collect()]

    good = written(stages["quality"](spark, docs, folder), "test")
    kept = {r["doc_id"] for r in quality.quality(docs, table(spark, folder, "labels"), "source", "lang").where("kept").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == kept
    assert good.count() == sum(i in kept for i, _ in every)
    poor = {r["doc_id"] for r in table(spark, folder, "labels").collect() if r["quality"] == 0}
    clean = {r["doc_id"] for r in table(spark, folder, "labels").collect() if r["quality"] == 1}
    assert len(kept & poor) <= 0.1 * len(poor & {i for i, _ in every}) and not (clean & {i for i, _ in every}) - kept

    known = written(stages["language"](spark, good, folder), "test")
    scored = language.language(good).collect()
    assert known.columns == docs.columns
    assert sorted(r["doc_id"] for r in known.collect()) == sorted(r["doc_id"] for r in scored if r["lang_pred"] != "und" and r["score"] >= 0.35)
    assert not {30_000, 30_001, 30_002} & {r["doc_id"] for r in known.collect()}

    one = written(stages["exact_dedup"](spark, known, folder), "test")
    last = {}
    for r in known.collect():
        last[normal(r["text"])] = max(r["doc_id"], last.get(normal(r["text"]), -1))
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(last.values())

    apart = written(stages["near_dedup"](spark, one, folder), "test")
    rows = sorted((r["doc_id"], r["text"]) for r in one.collect())
    roots = brute([text for _, text in rows])
    assert apart.columns == docs.columns and sorted(r["doc_id"] for r in apart.collect()) == sorted(i for at, (i, _) in enumerate(rows) if roots[at] == at)

    packed = stages["pack"](spark, apart, folder).collect()
    n, least = check_packing(packed, [(r["doc_id"], r["text"]) for r in apart.collect()], 1024)
    assert n <= least + 3
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect())) == sorted(tuple(r)[:5] for r in packed)


def test_an_empty_corpus(spark, tmp_path):
    table(spark, "/root/testdata/sf0.001", "documents").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, "/root/testdata/sf0.001", "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert P.path("byte_bpe_50k.json")
