import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import exact_dedup, simhash
from quillmark.llm.common import join_groups, table
from quillmark.llm.components import components
from quillmark.llm.exact_dedup import CuckooIndex
from tests.llm.helpers import ODD, SMALL, clashing, documents

digest = lambda x: hashlib.sha256(str(x).encode()).digest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("pdf"), st.integers(0, 60)), max_size=300))
def test_the_index_behaves_like_a_dictionary(steps):
    index, live = CuckooIndex(buckets=2), {}
    for n, (what, x) in enumerate(steps):
        key = digest(x)
        if what == "p":
            index.put(key, n)
            live[key] = n
        elif what == "d":
            assert index.delete(key) == (key in live)
            live.pop(key, None)
        else:
            assert index.find(key) == live.get(key)
    assert dict(index.items()) == live and index.size == len(live)
    assert all(index.maybe(k) for k in live)


def test_overflow_resizes_from_the_stored_keys():
    index = CuckooIndex(buckets=2)
    for i in range(3000):
        index.put(digest(i), i)
    assert index.n_buckets >= 1024 and all(index.find(digest(i)) == i for i in range(3000))
    for i in range(0, 3000, 2):
        assert index.delete(digest(i))
    assert all((index.find(digest(i)) == i) == (i % 2 == 1) for i in range(3000))
    assert sum(index.maybe(digest(i)) for i in range(10_000, 20_000)) < 50


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_dedup_against_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, "HELLO World"), (101, "É"), (102, "é"), (103, "hello world"), (None, "hello world"), (None, "alone"), (103, "hello world")]
    got = exact_dedup.exact_dedup(clashing(documents(spark, rows).repartition(4)), shards=3).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    want = sorted(((i, max((x for x in groups[normal(t)] if x is not None), default=None), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0


def test_exact_copies_are_dropped_with_all_columns_kept(spark):
    rows = [(1, "a"), (5, "A"), (5, "A"), (2, "b"), (None, "c"), (None, "c"), (7, None), (8, "")]
    df = clashing(documents(spark, rows))
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(5, "A"), (2, "b"), (None, "c"), (8, "")], key=str)
    assert exact_dedup.drop_exact_copies(documents(spark, [])).count() == 0


def test_groups_of_any_size_are_joined(spark):
    rows = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 'hot' ELSE concat('k', id % 700) END AS key", "id")
    groups = rows.groupBy("key").count().withColumnRenamed("count", "n")
    assert join_groups(rows, groups, "key", "n", 3000).count() == 3000


def brute_print(text, size=3):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", normal(text))]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_against_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK_WORDS", 7)
    rng = random.Random(2)
    texts = [t for t in ODD if t] + [" ".join(rng.choice("ab cd E f gh Ijk".split()) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    assert all(simhash.fingerprint(t.encode()) == brute_print(t) for t in texts)


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.fixture(scope="module")
def prints():
    """Random fingerprints, chains of near ones and a dense crowd."""
    rng = np.random.default_rng(4)
    out = set(rng.integers(0, 2**64, 150, np.uint64).tolist())
    for base in list(out)[:12]:
        x = base
        for _ in range(8):
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            out.add(x)
    centre = next(iter(out))
    out |= {centre ^ (1 << int(a)) ^ (1 << int(b)) for a in range(0, 64, 3) for b in range(0, 64, 5)}
    return sorted(out | {0})


@pytest.mark.parametrize("chain,block", [(2, 2048), (2, 20), (3, 2048), (5, 15)])
def test_every_choice_of_key_finds_the_same_components(spark, prints, chain, block):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long").repartition(4)
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.near_links(df, len(prints), chain, block).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    want = union([(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3], prints)
    assert union(links, prints) == want


def test_the_filter_never_loses_a_pair():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 4000, np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, int(rng.integers(0, 7)), replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    ka, ta = simhash.ring_keys(a, 2)
    kb, tb = simhash.ring_keys(b, 2)
    found = ((ka == kb) & simhash.near(ta, tb)).reshape(8, -1).any(axis=0)
    assert (found == (np.bitwise_count(a ^ b) <= 3)).all()


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(300, 300)]
    df = spark.createDataFrame([(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(pairs)] + [(None, 1)], "a long, b long")
    nodes = sorted({x for p in pairs for x in p if p[0] != p[1]})
    assert {r["node"]: r["root"] for r in components(df).collect()} == union([p for p in pairs if p[0] != p[1]], nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(rows):
    fp = [brute_print(t) for _, t in rows]
    index = union([(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3], range(len(rows)))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[index[i]] = min(doc_id, least.get(index[i], doc_id))
    return sorted(((d, f"{fp[i]:016x}", least.get(index[i])) for i, (d, _) in enumerate(rows)), key=str)


def test_simhash_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in simhash.op10_simhash(spark, SMALL).collect()), key=str) == brute_components(rows)


def test_simhash_of_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(i, t) for i, t in enumerate(ODD)] + [(50, long), (51, long + " tail"), (None, long), (52, ""), (50, long)]
    got = simhash.simhash_components(clashing(documents(spark, rows).repartition(3))).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)
    assert simhash.simhash_components(documents(spark, [])).count() == 0


def test_near_copies_are_dropped_with_all_columns_kept(spark):
    long = " ".join(f"word{i}" for i in range(400))
    df = clashing(documents(spark, [(3, long), (1, long + " tail"), (2, "something else entirely here"), (1, long + " tail"), (9, long.upper())]))
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert simhash.drop_near_copies(documents(spark, [])).count() == 0
