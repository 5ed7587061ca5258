import pytest
from pyspark.sql import functions as F

from quillmark.operators import layout
from quillmark.sources import refs

LINES = "document_id string, page int, seq int, text string, size double, indent double, right double, top double, bottom double, confidence double"


def lines(spark, rows):
    return spark.createDataFrame([("d", p, i, t, s, 50.0, 300.0, y + s, y, None) for i, (p, t, s, y) in enumerate(rows)], LINES)


SPEC = [(1, "Platform Specification", 20.0, 750.0), (1, "Introductory text about the platform and what it does.", 11.0, 720.0), (1, "Security", 14.0, 690.0), (1, "• Authenticate users", 11.0, 670.0), (1, "• Rotate keys", 11.0, 655.0), (1, "More prose follows the list and goes on.", 11.0, 640.0), (2, "Performance", 14.02, 750.0), (2, "Latency must stay low for every user.", 11.0, 730.0)]


def test_structure_of_a_specification(spark):
    df = lines(spark, SPEC)
    assert layout.body_size(df).first()["body_size"] == 11.0
    assert layout.heading_tiers(df).first()["tiers"] == [20.0, 14.02]
    rows = sorted(layout.structure(df).collect(), key=lambda r: r["ordinal"])
    assert [(r["type"], r["raw"]) for r in rows][:3] == [("heading", "Platform Specification"), ("paragraph", SPEC[1][1]), ("heading", "Security")]
    assert [r["raw"] for r in rows if r["type"] == "list_item"] == ["Authenticate users", "Rotate keys"]
    assert rows[2]["parent"] == 0 and rows[-1]["page"] == 2


def test_tables_take_their_lines(spark):
    df = lines(spark, SPEC)
    boxes = spark.createDataFrame([("d", 1, 685.0, 650.0, 40.0, 310.0, [["k", "v"]])], "document_id string, page int, top double, bottom double, left double, right double, rows array<array<string>>")
    assert {r["text"] for r in layout.outside_tables(df, boxes).collect()} == {t for _, t, _, _ in SPEC} - {"• Authenticate users", "• Rotate keys"}
    rows = layout.structure(df, boxes).collect()
    assert sum(r["type"] == "table" for r in rows) == 1 and not any(r["type"] == "list_item" for r in rows)


def test_lines_to_canonical_text(spark):
    from quillmark.operators.serialise import block_table, page_table, with_text

    df = lines(spark, SPEC)
    texts = with_text(layout.documents(df))
    row = texts.first()
    assert row["title"] == "Platform Specification" and row["text"].startswith("# Platform Specification\n\nIntroductory") and "- Authenticate users\n- Rotate keys" in row["text"]
    blocks = block_table(texts)
    assert all(row["text"][b["span_start"] : b["span_end"]] == b["own"] for b in blocks.collect() if not b["type"].startswith("list"))
    assert [r["number"] for r in page_table(blocks).orderBy("number").collect()] == [1, 2]


def test_recognised_pages_replace_their_lines(spark):
    df = lines(spark, [(1, "x" * 100, 10.0, 1.0), (2, "few", 10.0, 1.0), (3, "few", 10.0, 1.0)])
    decisions = spark.createDataFrame([("d", 1, "text_layer"), ("d", 2, "ocr"), ("d", 3, "ocr"), ("d", 4, "blank_page")], "document_id string, page int, decision string")
    read = spark.createDataFrame([("d", 2, 0, "recognised text", 10.0, 1.0, 2.0, 3.0, 1.0, 0.5)], LINES)
    assert {(r["page"], r["text"][:4]) for r in layout.with_ocr(df, decisions, read).collect()} == {(1, "xxxx"), (2, "reco"), (3, "few")}
    assert {r["number"]: (r["source"], r["confidence"]) for r in layout.page_meta(decisions, read).collect()} == {1: ("text_layer", None), 2: ("ocr", 0.5), 3: ("text_layer", None), 4: ("text_layer", None)}
    assert {(r["code"], r["page"]) for r in layout.page_warnings(decisions, read).collect()} == {("page_ocr_applied", 2), ("ocr_found_no_text", 3), ("blank_page", 4)}
    assert {r["code"] for r in layout.page_warnings(decisions).collect()} == {"page_needs_ocr", "blank_page"}


def test_pages_are_recognised_only_if_they_must_be(spark):
    df = lines(spark, [(1, "x" * 100, 10.0, 1.0), (2, "short", 10.0, 1.0)])
    images = spark.createDataFrame([("d", 1, 2), ("d", 2, 1), ("d", 3, 1), ("d", 4, 0)], "document_id string, page int, n_images int")
    assert {r["page"]: r["decision"] for r in layout.ocr_decision(df, images).collect()} == {1: "text_layer", 2: "ocr", 3: "ocr", 4: "blank_page"}


def test_words_to_lines(spark):
    words = [(0, "Hello", 90.0, 1), (1, "world", 80.0, 1), (2, "~", 5.0, 1), (3, " ", 99.0, 1), (4, "unknown", -1.0, 2)]
    df = spark.createDataFrame([("d", 1, i, t, c, 1, 1, n, 10.0 * i, 5.0, 8.0, 4.0) for i, t, c, n in words], "document_id string, page int, idx int, text string, conf double, block_num int, par_num int, line_num int, left double, top double, width double, height double")
    got = {r["line_num"]: r for r in layout.ocr_lines(df).collect()}
    assert got[1]["text"] == "Hello world" and abs(got[1]["confidence"] - 0.85) < 1e-9 and got[1]["right"] == 18.0
    assert got[2]["confidence"] is None


def test_glyphs_to_lines(spark):
    rows = [("d", 1, i, c, 10.0 + i % 2, float(i), i + 1.0, 20.0, 10.0) for i, c in enumerate("ab\r\ncd")]
    df = spark.createDataFrame(rows, "document_id string, page int, seq int, char string, size double, left double, right double, top double, bottom double")
    assert sorted(r["text"] for r in layout.reconstruct_lines(df).collect()) == ["ab", "cd"]


@pytest.mark.parametrize("given,wanted", [("Untitled", None), (" Real ", "Real"), ("", None), ("n/a", None)])
def test_placeholder_metadata(spark, given, wanted):
    assert spark.createDataFrame([(given,)], "v string").select(layout.clean_metadata(F.col("v"))).first()[0] == wanted


REFS = [
    ("s3://b/k%20x/y?versionId=3", ("s3", "b", "k x/y", "3", None)),
    ("s3://b", (None, None, None, None, "s3 reference needs a bucket and a key: s3://b")),
    ("https://bkt.s3.eu-west-1.amazonaws.com/a/b.pdf?X-Sig=1", ("http", "bkt", "a/b.pdf", None, None)),
    ("https://s3.us-east-1.amazonaws.com/bkt/a+b", ("http", "bkt", "a+b", None, None)),
    ("https://example.com/x", ("http", None, None, None, None)),
    ("file:///tmp/a%20b", ("file", None, None, None, None)),
    ("/tmp/x", ("file", None, None, None, None)),
    ("ftp://h/x", (None, None, None, None, "unsupported reference scheme ftp")),
    ("  ", (None, None, None, None, "empty object reference")),
]


@pytest.mark.parametrize("given,wanted", REFS)
def test_references(spark, given, wanted):
    r = spark.createDataFrame([(given,)], "u string").select(refs.parse_ref(F.col("u")).alias("r")).select("r.*").first()
    assert (r["kind"], r["bucket"], r["key"], r["version_id"], r["error"]) == wanted


@pytest.mark.parametrize(
    "url,addresses,problem",
    [
        ("https://ok.example.com/x", ["93.184.216.34"], None),
        ("http://ok.example.com/x", ["93.184.216.34"], "scheme is not permitted"),
        ("https://ok.example.com/x", ["93.184.216.34", "10.0.0.1"], "10.0.0.1 is private"),
        ("https://ok.example.com/x", ["169.254.169.254"], "169.254.169.254 is link-local"),
        ("https://ok.example.com/x", ["::ffff:127.0.0.1"], "::ffff:127.0.0.1 is loopback"),
        ("https://ok.example.com/x", [], "host resolves to no addresses"),
        ("https://evil.test/x", ["93.184.216.34"], "host is not in the allowlist"),
    ],
)
def test_address_guard(spark, url, addresses, problem):
    df = spark.createDataFrame([(url, addresses)], "u string, a array<string>")
    assert df.select(refs.url_problem(F.col("u"), F.col("a"), (".example.com",))).first()[0] == problem
