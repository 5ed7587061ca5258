import random

import numpy as np
import pytest

from quillmark.llm import shingles, simhash
from tests.llm.helpers import ODD, clashing, documents
from tests.llm.test_dedup import normal, union


def sets_of(text, size=5):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", normal(text))]
    return frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def same(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def corpus(seed=5):
    """Texts at graded distances from their bases, a crowd around one text, and odd texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    out = list(ODD)
    for b in range(25):
        base = [word() for _ in range(rng.randint(60, 400))]
        out.append(" ".join(base))
        for changes in (1, 2, 4, 8) if b else [3] * 40:
            words = list(base)
            for i in rng.sample(range(len(words)), changes):
                words[i] = word()
            out.append("  ".join(words).upper() if changes == 2 else " ".join(words))
    return out


def brute(texts):
    """Position -> root position."""
    found = [sets_of(t) for t in texts]
    return union([(i, j) for i in range(len(texts)) for j in range(i) if same(found[i], found[j])], range(len(texts)))


def test_near_copies_against_brute_force_jaccard(spark):
    texts = corpus()
    roots = brute(texts)
    kept = simhash.drop_near_copies(documents(spark, list(enumerate(texts))).repartition(5)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, r in roots.items() if i == r)
    assert len(kept) < len(texts) - 60


@pytest.mark.parametrize("stars,block", [(0, 256), (0, 7), (1, 5)])
def test_every_way_through_a_bucket_finds_the_same_components(spark, stars, block):
    texts = corpus(6)
    roots = brute(texts)
    got = {r["doc_id"]: r["root"] for r in shingles.similar_components(documents(spark, list(enumerate(texts))), stars, block).collect()}
    pairs = {(roots[i], got[i]) for i in roots}
    assert len(pairs) == len(set(roots.values())) == len(set(got.values()))


def test_recall_of_the_bands_at_the_least_similarity():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(2000):
        x = rng.integers(0, 2**64, 100, np.uint64)  # 80 shared of 100 together: 0.8
        a, b = x[:90], np.concatenate([x[:80], x[90:]])
        assert shingles.similar(np.sort(a), np.sort(b)) and not shingles.similar(np.sort(a[1:]), np.sort(b))
        missed += not (shingles.band_keys(shingles.sketch_of(a)) == shingles.band_keys(shingles.sketch_of(b))).any()
    assert missed <= 3


def test_rows_without_an_id_and_an_id_of_two_texts(spark):
    texts = [" ".join(f"{c}{i}" for i in range(120)) for c in "abcdefg"]
    near = lambda t: t + " tail"
    rows = [(None, texts[0]), (None, texts[1]), (None, near(texts[1])), (None, texts[2]), (7, near(texts[2])), (5, texts[3]), (5, texts[4]), (9, near(texts[4])), (5, texts[4].upper()), (8, texts[5]), (8, texts[5])]
    want = [(None, texts[0]), (7, near(texts[2])), (5, texts[3]), (5, texts[4].upper()), (8, texts[5])]
    for parts in (1, 4):
        df = clashing(documents(spark, rows).repartition(parts))
        kept = simhash.drop_near_copies(df)
        assert kept.columns == df.columns
        got = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert sum(x in ((None, texts[1]), (None, near(texts[1]))) for x in got) == 1
        assert sorted((x for x in got if x[0] is not None or x[1] == texts[0]), key=str) == sorted(want, key=str)
        assert len(got) == len(want) + 1


def test_the_last_round_is_a_short_plan_and_sends_no_text_through_the_driver(spark):
    node = lambda i: i.to_bytes(16, "big")
    members = spark.createDataFrame([(k, node(i), node(i)) for k in range(5) for i in range(k, 30)], "key long, node binary, root binary")
    words = lambda i: " ".join(f"w{j + i // 10 * 100}" for j in range(i % 2, 60)).encode()
    found = [(node(i), words(i), shingles.sketch_of(shingles.shingles(words(i).split())).tobytes()) for i in range(30)]
    links = shingles._remaining(members, spark.createDataFrame(found, "node binary, words binary, sketch binary"), 7)
    plan = links._sc._jvm.PythonSQLUtils.explainString(links._jdf.queryExecution(), "formatted")
    assert plan.count("Exchange\n") <= 12
    assert not [x for x in plan.split("\n\n") if "BroadcastExchange" in x.split("\n")[0] and "words" in x]
    assert {frozenset(r) for r in links.collect()} and all(int.from_bytes(r["a"], "big") // 10 == int.from_bytes(r["b"], "big") // 10 for r in links.collect())


def test_the_stage_takes_its_first_candidates_from_the_simhash_search(spark, monkeypatch):
    texts = corpus(7)
    roots, searched, near = brute(texts), [], simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda prints, n: searched.append((prints, n)) or near(prints, n))
    checked, verified = [], shingles._verified
    monkeypatch.setattr(shingles, "_verified", lambda pairs, words: checked.append(pairs) or verified(pairs, words))
    kept = simhash.drop_near_copies(documents(spark, list(enumerate(texts))))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in roots.items() if i == r)
    prints = [shingles.print_of(shingles.shingles(shingles.words_of((t or "").encode()))) for t in texts]
    assert len(searched) == 1 and searched[0][1] == len(set(prints)) and {r["fp"] for r in searched[0][0].collect()} == set(prints)
    # of the first candidates every component of prints within 3 bits is whole
    nodes = [shingles.node_of(shingles.words_of((t or "").encode())) for t in texts]
    at = {n: i for i, n in reversed(list(enumerate(nodes)))}
    differ = lambda i, j: ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count()
    firsts = sorted(set(at.values()))
    want = union([(i, j) for i in firsts for j in firsts if j < i and differ(i, j) <= 3], firsts)
    assert union([(at[bytes(r["a"])], at[bytes(r["b"])]) for r in checked[0].collect()], firsts) == want
    assert len(set(want.values())) < len(firsts)
