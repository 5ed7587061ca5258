import pytest

from quillmark.operators import locate, lookup
from quillmark.plans.documents import build
from tests.test_parsers import RICH, raw


def ask(spark, doc, *quotes):
    result = build(raw(spark, doc))
    rows = spark.createDataFrame([("0", i, q) for i, q in enumerate(quotes)], "document_id string, quote_idx int, quote string")
    found = locate.locate(rows, result.artifacts.select("document_id", "text"), result.blocks, result.pages)
    return [r for r in found.orderBy("quote_idx").collect()]


def test_exact_snapped_short_and_absent(spark):
    exact, near, short, absent, blank = ask(spark, ("r.md", RICH.encode()), "AUTHENTICATE USERS  within 300MS", "Rotate API keys every 90 dayz without exception", "the", "nothing of the kind is written here", "        ")
    assert exact["match"] == "exact" and exact["text"] == "Authenticate users within 300ms" and exact["similarity"] == 1.0
    assert near["match"] == "snapped" and near["text"] == "Rotate API keys every 90 days without exception" and 0.9 <= near["similarity"] < 1
    assert not short["found"] and short["reason"].startswith("too short to be a citation (3 chars)")
    assert not absent["found"] and absent["reason"] == locate.ABSENT
    assert not blank["found"] and blank["reason"].startswith("too short")


def test_occurrences_spans_and_blocks(spark):
    text = "Repeated sentence here. Repeated sentence here.\n\nOther “words” stand — here."
    twice, folded = ask(spark, ("t.txt", text.encode()), "repeated sentence here", 'Other "words" stand - here.')
    assert twice["occurrences"] == 2 and (twice["span_start"], twice["span_end"]) == (0, 22)
    assert folded["match"] == "exact" and folded["text"] == "Other “words” stand — here." and folded["block_id"] is not None


def test_a_quote_of_a_parent_item_snaps_to_its_own_line(spark):
    doc = b"- Every request must carry a signed token\n  - child one\n  - child two that is long and says other things\n"
    (near,) = ask(spark, ("l.md", doc), "Every request must carry a signd token")
    assert near["match"] == "snapped" and near["text"] == "Every request must carry a signed token"


@pytest.mark.parametrize("few", [0, 20_000])
def test_corpus_search_agrees_with_a_scan(spark, monkeypatch, few):
    monkeypatch.setattr(locate, "FEW_QUOTES", few)
    texts = ["the quick brown fox jumps over it", "a quick brown fox", "xxquick brown foxes", "brown fox jumps", "quick  BROWN fox", ""]
    quotes = ["quick brown fox", "brown fox", "fox jumps", "quick brown fox jumps over", "short", "absent from here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string")
    got = {(r["quote_id"], r["document_id"]): (r["position"], r["occurrences"]) for r in locate.locate_corpus(asked, docs).collect()}
    fold = lambda t: " ".join(t.lower().split())
    want = {(i, j): (fold(t).find(fold(q)), fold(t).count(fold(q))) for i, q in enumerate(quotes) for j, t in enumerate(texts) if len(q) >= 8 and fold(q) in fold(t)}
    assert got == want


def test_lookups_by_offset(spark):
    blocks = spark.createDataFrame([("d", 0, 0, 30), ("d", 1, 0, 30), ("d", 2, 5, 9), ("d", 3, 9, 9)], "document_id string, ordinal int, span_start int, span_end int")
    asked = spark.createDataFrame([("d", 6), ("d", 9), ("d", 0), ("d", 30), ("e", 1), ("d", 6)], "document_id string, offset int")
    got = sorted(((r["document_id"], r["offset"]), r["block_ordinal"]) for r in lookup.block_at(asked, blocks).where("block_ordinal IS NOT NULL").collect())
    assert got == [(("d", 0), 1), (("d", 6), 2), (("d", 6), 2), (("d", 9), 1)]
    pages = spark.createDataFrame([("d", 1, 0, 10), ("d", 2, 8, 20)], "document_id string, number int, span_start int, span_end int")
    assert {(r["offset"], r["page"]) for r in lookup.page_at(asked.where("document_id = 'd'"), pages).collect()} == {(6, 1), (9, 1), (0, 1), (30, None)}
    assert sorted(r["offset"] for r in lookup.page_at(asked.where("document_id = 'd'"), pages).collect()) == [0, 6, 6, 9, 30]


def test_heading_paths(spark):
    result = build(raw(spark, ("r.md", RICH.encode())))
    paths = {r["ordinal"]: r["path"] for r in lookup.heading_path(result.blocks).collect()}
    table = result.blocks.where("type = 'table'").first()
    assert paths[table["ordinal"]] == ["Platform", "Security", "Compliance"] and paths[0] == ["Platform"]
    assert lookup.table_shape(result.blocks).select("n_rows", "n_columns").first() == (3, 3)


def test_heading_paths_of_great_depth(spark):
    rows = [("d", i, i - 1 if i else None, "heading", f"# h{i}") for i in range(300)] + [("e", 0, None, "paragraph", "x")]
    blocks = spark.createDataFrame(rows, "document_id string, ordinal int, parent int, type string, own string")
    paths = {(r["document_id"], r["ordinal"]): r["path"] for r in lookup.heading_path(blocks).collect()}
    assert len(paths) == 301 and paths["e", 0] == [] and all(paths["d", i] == [f"h{j}" for j in range(i + 1)] for i in range(300))


def test_plans_stay_equi_joins(spark):
    docs = spark.createDataFrame([(0, "x")], "document_id long, text string")
    quotes = spark.createDataFrame([(0, "one two three four")], "quote_id long, quote string")
    plan = locate.locate_corpus(quotes, docs)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
