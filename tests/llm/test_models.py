import html
import itertools
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import html_content, html_pages, language, quality
from quillmark.llm.common import table
from tests.llm.helpers import ODD, clashing, documents

MIDDLE = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- language


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    k, psi = 3, rng.uniform(0.1, 2, (5, 3))
    step, start = rng.uniform(0.1, 1, (3, 3)), rng.uniform(0.1, 1, 3)
    counts = np.array([4, 1, 3])
    index = rng.integers(0, 5, 8)
    post, pairs, first, norm = language.chains(psi, index, counts, step, start)
    want, want_pairs, want_first, want_norm = np.zeros((8, k)), np.zeros((k, k)), np.zeros(k), 0.0
    for lo, n in zip(np.cumsum(counts) - counts, counts, strict=True):
        total, own, own_pairs, own_first = 0.0, np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)
        for path in itertools.product(range(k), repeat=int(n)):
            w = start[path[0]] * np.prod([psi[index[lo + t], s] for t, s in enumerate(path)]) * np.prod([step[a, b] for a, b in zip(path, path[1:], strict=False)])
            total += w
            own_first[path[0]] += w
            for t, s in enumerate(path):
                own[t, s] += w
            for a, b in zip(path, path[1:], strict=False):
                own_pairs[a, b] += w
        want[lo : lo + n], want_norm = own / total, want_norm + np.log(total)
        want_pairs += own_pairs / total
        want_first += own_first / total
    assert np.allclose(post, want) and np.allclose(pairs, want_pairs) and np.allclose(first, want_first) and np.isclose(norm, want_norm)


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(table(spark, MIDDLE, "documents"), 400)


def test_held_out_accuracy(spark, model):
    rows = table(spark, MIDDLE, "documents").select("doc_id", "text", "lang").collect()
    out = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    sums, _ = language.posterior_sums(pa.array([r["text"] for r in out]), model)
    right = [model["langs"][i] == r["lang"] for i, r in zip(sums.argmax(axis=1), out, strict=True)]
    assert len(out) > 200 and np.mean(right) > 0.97


def test_code_switched_text_is_labelled_word_by_word(spark, model):
    rows = {r["lang"]: r["text"] for r in table(spark, MIDDLE, "documents").where("length(text) BETWEEN 400 AND 3000").orderBy("doc_id").select("lang", "text").collect()}
    a, b = (" ".join(rows[x].split()[:60]) for x in ("de", "es"))
    words, index, counts = language.words_of(pa.array([a + " " + b]))
    post = language.chains(language.potentials(language.scores(words, model)), index, counts, model["step"], model["start"])[0]
    found = [model["langs"][i] for i in post.argmax(axis=1)]
    assert np.mean([x == "de" for x in found[:55]]) > 0.9 and np.mean([x == "es" for x in found[-55:]]) > 0.9


def test_language_of_odd_rows(spark):
    train = [(i, "the cat and the dog of house " * 3, "en") for i in range(40)] + [(i, "der hund und die katze von haus " * 3, "de") for i in range(40, 80)]
    odd = [(100 + i, t, None) for i, t in enumerate(ODD)] + [(None, "the dog", "en"), (200, "12 34 !!", "en"), (5, "the cat and the dog of house " * 3, "en")]
    got = language.language(clashing(documents(spark, train + odd))).collect()
    assert len(got) == len(train) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert by[None]["lang_pred"] == "en" and by[None]["held_out"] is False and by[200]["lang_pred"] == "und" and by[200]["score"] == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert by[104]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got)
    assert language.language(documents(spark, [])).count() == 0
    unlabelled = language.language(documents(spark, [(1, "words here", None)])).first()
    assert (unlabelled["lang_pred"], unlabelled["score"]) == ("und", 0.0)


def test_rows_without_a_language_are_dropped(spark):
    rows = [(i, "the cat and the dog of house " * 3, "en") for i in range(20)] + [(50, "12 34", "en"), (51, None, "en"), (52, "", None)]
    df = clashing(documents(spark, rows))
    kept = language.drop_unknown(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(20))
    assert language.drop_unknown(documents(spark, [])).count() == 0


# ---------------------------------------------------------------- quality


def test_held_out_quality(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    some = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    got = {r["doc_id"]: r["kept"] for r in quality.quality(docs, some, "source", "lang").collect()}
    rest = labels.where("pmod(xxhash64(doc_id), 2) = 1").collect()
    good = [got[r["doc_id"]] for r in rest if r["quality"] == 1]
    bad = [not got[r["doc_id"]] for r in rest if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) > 0.9


def test_sparse_sites_shrink_toward_their_prior_and_large_ones_do_not(spark):
    rng = np.random.default_rng(0)
    rows = []
    for host, n, p in (("good", 400, 0.95), ("bad", 400, 0.1), ("mixed", 400, 0.5), ("tiny", 1, 0.02)):
        rows += [(f"{host}", "a" if i % 2 else "b", float(np.clip(rng.normal(p, 0.05), 0.01, 0.99))) for i in range(n)]
    df = spark.createDataFrame([(i, h, q, float(np.log(p / (1 - p))), p) for i, (h, q, p) in enumerate(rows)], "doc_id long, host string, path string, logit double, p double")
    got = quality.Sites(df).joined(df).groupBy("host").avg("site").collect()
    site = {r["host"]: r["avg(site)"] for r in got}
    assert site["good"] > 0.9 and site["bad"] < 0.15 and 0.2 < site["tiny"] < 0.7  # far from its own 0.02


def test_quality_of_odd_rows(spark):
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else f"h{i}") for i, t in enumerate(ODD)] + [(3, "again", "en", "h"), (None, "no id", "en", "h")]
    labels = spark.createDataFrame([(3, 1), (3, 1), (None, 0), (4, None), (9, 0), (999, 1)], "doc_id long, quality int")
    df = clashing(documents(spark, rows))
    got = quality.quality(df, labels, "source", "lang").collect()
    assert len(got) == len(rows) and all(0 <= r["quality"] <= 1 for r in got)
    none = labels.where("false")
    assert all(r["kept"] for r in quality.quality(df, none, "source").collect())
    assert quality.quality(documents(spark, []), labels).count() == 0
    kept = quality.drop_poor(df, none, "source", "lang")
    assert kept.columns == df.columns and kept.count() == len(rows)
    assert quality.drop_poor(documents(spark, []), labels).count() == 0


def test_dropping_agrees_with_scoring(spark):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    want = {r["doc_id"] for r in quality.quality(docs, labels, "source", "lang").where("kept").collect()}
    assert {r["doc_id"] for r in quality.drop_poor(docs, labels, "source", "lang").collect()} == want


# ---------------------------------------------------------------- pages


def test_messages_against_all_labellings():
    nodes, _ = html_content.parse("<div><p>a</p><ul><li>b<li>c</ul></div><nav>x</nav>")
    rng = np.random.default_rng(2)
    unary, pair = rng.normal(0, 1, len(nodes)).tolist(), rng.uniform(0.2, 2, (html_content.EDGES, 4)).tolist()
    got, joints = html_content.messages(nodes, unary, pair)
    want, total = np.zeros(len(nodes)), 0.0
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        w = np.exp(sum(u for u, s in zip(unary, labels, strict=True) if s)) * np.prod([pair[html_content.edge_kind(n)][2 * labels[n.parent.order] + labels[n.order]] for n in nodes[1:]])
        total += w
        want += w * np.array(labels)
    assert np.allclose(got, want / total) and len(joints) == len(nodes) - 1


@pytest.mark.parametrize("names,bar", [("own", 0.02), ("mixed", 0.02), ("invented", 0.06), ("none", 0.06)])
def test_held_out_pages(names, bar):
    """Where no name says anything an advert in the article can look like a paragraph, so the bar is lower there."""
    model = html_content.default_model()
    right = wrong = 0
    for seed in range(5000, 5150):
        source = html_pages.page(seed, names)
        nodes, blocks = html_content.parse(source)
        marginals, _ = html_content.messages(nodes, [sum(model[0][f] for f in on) for on in html_content.features(nodes)], model[1])
        for i, _ in blocks:
            right += nodes[i].label == (marginals[i] > 0.5)
            wrong += nodes[i].label != (marginals[i] > 0.5)
    assert wrong / (right + wrong) < bar


def test_the_query_against_the_articles_of_the_pages(spark):
    """The pages of the test tables hold one article element each, so a plain cut gives the same text."""
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"] or "", re.S)
        blocks = re.split(r"</?(?:p|h1|div)\b[^>]*>", inner[1]) if inner else []
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in blocks]
        want[r["page_id"]] = "\n".join(x for x in lines if x)
    got = {r["page_id"]: r["text"] for r in html_content.op2_html_content(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and any(want.values())


BODY = "<h1>A title</h1><p>One sentence here. Another one there, with words.</p><p>More text follows in this one. It goes on.</p>"


@pytest.mark.parametrize(
    "around",
    [
        '<article class="sports-form">%s</article>',
        '<main class="side-nav-open"><article>%s</article></main>',
        '<div class="post alert">%s</div>',
        '<div id="main" class="page-header-fixed"><div class="content">%s</div></div>',
        "<article><div><button>Share<svg></button></div>%s</article>",
        "<article><div><button>Share<svg></div>%s</article>",
        "<article>%s<div><select><option>x</div></article>",
    ],
)
def test_articles_with_misleading_names_and_controls_left_open(around):
    page = f"<html><body><nav><ul><li><a href=x>home</a><li><a href=y>news</a></ul></nav>{around % BODY}<footer>all rights</footer>"
    assert html_content.content_blocks(page, html_content.default_model()) == ["A title", "One sentence here. Another one there, with words.", "More text follows in this one. It goes on."]


def test_formulas_and_fallback_text_stay():
    page = "<article><h1>A title</h1><p>The value of <math><mi>x</mi></math> is known, and so on. It is <noscript>three</noscript>.</p></article>"
    assert html_content.content_blocks(page, html_content.default_model())[1] == "The value of x is known, and so on. It is three."


@pytest.mark.parametrize("piece", ['<a "', '<a b="', "<!--", "<li><center>", "</script <", "<script></script ", "<p class='", "<div>", '<a ">" ', "<a =", "</x <div>"])
def test_time_grows_with_the_length_whatever_the_markup(piece):
    model = html_content.default_model()

    def took(n):
        begun = time.process_time()
        html_content.content_blocks(piece * (n // len(piece)), model)
        return time.process_time() - begun

    assert took(400_000) < 12 * took(100_000) + 0.5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<header>Site name</header><div class="ad">Buy this now.</div><article><h1>Real &amp; true title</h1><p><b>Opening words of it.<br><p>Second paragraph, with a <a href="/x">link</a> in&nbsp;it &#8212; and more text.</p>
<p>Third
 one   here.</p><div class="advert"><p>Sponsored words stand here.</p></div></article><section id="comments"><div class="comment"><p>I liked this article a lot.</p></div></section>
<aside><h3>Related</h3><p>Another story that is not part of it.</p></aside><form><label>Search</label><input></form><footer>&copy; x.example &middot; All rights.</footer></body></html>"""


def test_a_page_in_full():
    text = "\n".join(html_content.content_blocks(PAGE, html_content.default_model()))
    assert text == "Real & true title\nOpening words of it.\nSecond paragraph, with a link in it — and more text.\nThird one here."


def test_pages_of_odd_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "u", ""), (3, "u", "no markup at all"), (4, "u", "<article><p>" + "word " * 100_000), (5, "u", "<<<>>><p"), (6, "u", "<script>never closed"), (7, "u", "<article>" + "<div>" * 3000 + "<p>deep text here.</p>")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = html_content.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[None] == by[2] == by[6] == "" and len(by[4]) == 499_999
    assert html_content.extract(df.where("false")).count() == 0


def test_scoring_languages_takes_little_memory_at_once():
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 12))) for _ in range(400)) for _ in range(2600)]
    model = language.train([f"{w} {w}s {t[:400]}" for w, t in zip(["the", "und"] * 20, texts, strict=False)], ["en", "de"] * 20)
    tracemalloc.start()
    column, most = pa.array(texts), 0
    for lo, hi in language.slices(column, language.SLICE_BYTES):
        language.posterior_sums(column.slice(lo, hi - lo), model)
        most = max(most, tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert most < 96 << 20  # 162 MB with slices of 6 MB
    assert most < 192 << 20
