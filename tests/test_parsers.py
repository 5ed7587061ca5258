import io
import random
import zipfile

import pytest

from quillmark.errors import ParseFailure
from quillmark.operators import parsers
from quillmark.operators.parse import parse
from quillmark.operators.parsers import delimited, image, markdown, markup, office
from quillmark.plans.documents import build

RICH = """# Platform

Intro paragraph.

## Security

- Authenticate users within 300ms
  - Log failures
- Rotate API keys every 90 days without exception.

### Compliance

| Control | Owner | State |
| --- | --- | --- |
| A\\|1 | ops | done |
| A2 | dev | open |

## Performance

Latency stays
low.

```python
def f():
    return 1
```
"""
RAW = "document_id string, filename string, declared_media_type string, content binary"


def raw(spark, *docs):
    return spark.createDataFrame([(str(i), name, None, bytearray(data)) for i, (name, data) in enumerate(docs)], RAW)


def kinds(rows):
    return [(r["type"], r["depth"], r["raw"]) for r in rows]


def test_markdown_structure():
    out = markdown.parse(RICH.encode())
    rows = out.rows()
    assert out.meta["title"] == "Platform" and out.meta["format"] == "markdown"
    by_text = {r["raw"]: r for r in rows}
    assert rows[by_text["Log failures"]["parent"]]["type"] == "list" and by_text["Log failures"]["depth"] == 2
    assert rows[by_text["Compliance"]["parent"]]["raw"] == "Security"
    assert rows[by_text["Performance"]["parent"]]["raw"] == "Platform"
    table = next(r for r in rows if r["type"] == "table")
    assert table["rows"][1][0] == "A|1"
    assert next(r for r in rows if r["type"] == "code")["raw"] == "def f():\n    return 1"
    assert by_text["Latency stays low."]["type"] == "paragraph"
    assert all(r["parent"] is None or r["parent"] < r["ordinal"] for r in rows)


@pytest.mark.parametrize("text,wanted", [("1. a\n2. b\n3. c", [1, 2, 3]), ("0. z", [0]), ("7) q", [7])])
def test_ordered_lists_keep_their_numbers(text, wanted):
    assert [r["number"] for r in markdown.parse(text.encode()).rows() if r["type"] == "list_item"] == wanted


def test_unclosed_fence_rule_and_blank_documents():
    assert kinds(markdown.parse(b"```\ncode").rows()) == [("code", 0, "code")]
    assert kinds(markdown.parse(b"a\n\n---\n\nb").rows()) == [("paragraph", 0, "a"), ("paragraph", 0, "b")]
    assert markdown.parse(b" \n\n").rows() == []


PAGE = b"""<html><head><title>Spec</title><style>p{}</style></head><body><nav>menu</nav><h1>Spec</h1><p>First &amp; one<br>more</p>
<h2>Part</h2><ul><li>a</li><li>b</li></ul><ol><li>c</li></ol><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table><pre>x
 y</pre><script>var a = "</p>";</script><footer>foot</footer></body></html>"""


def test_html_structure():
    out = markup.parse(PAGE)
    rows = out.rows()
    assert out.meta["title"] == "Spec"
    assert kinds(rows)[:2] == [("heading", 1, "Spec"), ("paragraph", 0, "First & one more")]
    assert [r["raw"] for r in rows if r["type"] == "list_item"] == ["a", "b", "c"]
    assert next(r for r in rows if r["type"] == "table")["rows"] == [["k", "v"], ["1", "2"]]
    assert next(r for r in rows if r["type"] == "code")["raw"] == "x\n y"
    assert not any(x in r["raw"] for r in rows for x in ("menu", "foot", "var a"))


def test_html_limits_are_kept():
    assert kinds(markup.parse(b"<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>").rows())[1:] == [("list_item", 1, "c")]
    assert kinds(markup.parse(b"text<p>more</p>").rows()) == [("paragraph", 0, "textmore")]
    assert kinds(markup.parse(b"<p>a<br/>b</p>").rows()) == [("paragraph", 0, "a"), ("paragraph", 0, "b")]
    assert markup.parse(b"<head>never closed<body><p>x</p>").rows() == []


@pytest.mark.parametrize("text,delimiter", [("a,b\n1,2\n3,4", ","), ("a;b\n1,5;2\n3,1;4", ";"), ("a\tb\n1\t2", "\t"), ("a|b\n1|2", "|")])
def test_delimiters(text, delimiter):
    assert delimited.delimiter_of(text) == delimiter
    assert delimited.parse(text.encode()).rows()[0]["rows"][0] == ["a", "b"]


def test_csv_is_padded_cut_and_refused():
    assert delimited.parse(b"a,b,c\n1,2\n\n,,\n3,4,5").rows()[0]["rows"] == [["a", "b", "c"], ["1", "2", ""], ["3", "4", "5"]]
    long = "\n".join(f"{i},x" for i in range(5003)).encode()
    assert delimited.parse(long).warnings[0][0] == "rows_truncated" and len(delimited.parse(long).rows()[0]["rows"]) == 5000
    assert delimited.parse(b"one\ntwo\n").warnings[0][0] == "single_column"
    for empty in (b"  \n", b",,\n,,\n"):
        with pytest.raises(ParseFailure):
            delimited.parse(empty)


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(paragraphs, core=""):
    body = "".join(x if x.startswith("<") else "" for x in paragraphs)
    names = ["heading 1", "heading 2", "List Bullet", "List Bullet 2", "List Number", "Normal"]
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{n.replace(" ", "")}"><w:name w:val="{n}"/></w:style>' for n in names)
    parts = {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>"}
    if core:
        parts["docProps/core.xml"] = core
    return zipped(parts)


def p(text, style=""):
    own = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{own}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx():
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('k')}{cell('v')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    core = '<c:coreProperties xmlns:c="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:d="http://purl.org/dc/elements/1.1/"><d:creator>Ann</d:creator><d:title> </d:title><c:keywords>a; b,c</c:keywords></c:coreProperties>'
    data = docx([p("Top", "heading1"), p("one", "ListBullet"), p("inner", "ListBullet2"), p("first", "ListNumber"), p("Sub", "heading2"), table, p("end")], core)
    out = office.parse_docx(data)
    rows = out.rows()
    assert out.meta["author"] == "Ann" and out.meta["keywords"] == ["a", "b", "c"] and out.meta["title"] == "Top"
    by = {r["raw"]: r for r in rows}
    assert by["inner"]["depth"] == 2 and by["first"]["number"] == 2 and by["Sub"]["parent"] == 0
    assert next(r for r in rows if r["type"] == "table")["rows"] == [["k", "v"], ["1", "2"]]
    with pytest.raises(ParseFailure):
        office.parse_docx(b"PK\x03\x04broken")


def test_xlsx():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>flag</t></is></c></row><row r="2"><c r="A2"><v>7.0</v></c><c r="B2" t="b"><v>1</v></c></row><row r="4"><c r="A4"><v>2.5</v></c></row><row r="9"/></sheetData></worksheet>'
    data = zipped({"xl/workbook.xml": f'<workbook {ns} {rel}><sheets><sheet name="Fields" r:id="rId1"/><sheet name="Empty" r:id="rId2"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>', "xl/sharedStrings.xml": f"<sst {ns}><si><t>years</t></si></sst>", "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": f"<worksheet {ns}><sheetData/></worksheet>"})
    out = office.parse_xlsx(data)
    rows = out.rows()
    assert out.meta["title"] == "Fields" and [w[0] for w in out.warnings] == ["empty_sheet"]
    assert rows[1]["rows"] == [["years", "flag"], ["7", "true"], ["", ""], ["2.5", ""]]


def test_images_need_a_reader():
    with pytest.raises(ParseFailure) as e:
        image.parse(b"x", None)
    assert e.value.failure == "ocr_unavailable"
    out = image.parse(b"x", lambda data, dpi: ([image.Line("Title line", 0.4)], 0.4))
    assert out.meta["title"] == "Title line" and out.warnings[0][0] == "low_ocr_confidence" and out.pages == {1: ("ocr", 0.4)}
    with pytest.raises(ParseFailure):
        image.parse(b"x", lambda data, dpi: ([], None))


def test_failures_are_rows_not_crashes(spark):
    docs = [("a.json", b"{}"), ("b.bin", b"\x00\x01"), ("c.csv", b"\n"), ("d.txt", b""), ("e.docx", zipped({"word/x": "y"})), ("f.png", b"\x89PNG\r\n\x1a\n..")]
    got = {r["document_id"]: r["failure"] for r in parse(raw(spark, *docs)).collect()}
    assert got == {"0": "unsupported_format", "1": "unsupported_format", "2": "corrupt", "3": "not_found", "4": "corrupt", "5": "ocr_unavailable"}


def invariants(result):
    """Spans give the text back, parents precede children, containers cover their descendants."""
    texts = {r["document_id"]: r["text"] for r in result.artifacts.collect()}
    rows = {}
    for r in result.blocks.collect():
        rows.setdefault(r["document_id"], {})[r["ordinal"]] = r
    for d, blocks in rows.items():
        for r in blocks.values():
            if r["type"] not in ("list", "list_item"):
                assert texts[d][r["span_start"] : r["span_end"]] == r["own"]
            assert texts[d][r["own_end"] - len(r["own"]) : r["own_end"]] == r["own"]
            up = r["parent"]
            while up is not None:
                parent = blocks[up]
                assert up < r["ordinal"]
                if parent["type"] in ("list", "list_item"):
                    assert parent["span_start"] <= r["span_start"] and r["span_end"] <= parent["span_end"]
                up = parent["parent"]
    return texts


def test_spans_hold_on_every_kind_of_document(spark):
    rng = random.Random(3)
    lines = ["# h", "## k", "- a", "  - b", "    1. c", "", "text \U0001f600 more", "| x | y |", "| --- | --- |", "```", "* * *", "\t- tab"]
    made = [("m.md", "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 25))).encode()) for _ in range(40)]
    made = [x for x in made if x[1].strip()]
    texts = invariants(build(raw(spark, ("r.md", RICH.encode()), ("p.html", PAGE), ("c.csv", b"a,b\n1,2"), *made)))
    assert texts["0"].startswith("# Platform\n\nIntro paragraph.\n\n## Security\n\n- Authenticate users within 300ms\n  - Log failures\n- Rotate")


def test_parsing_once_gives_the_same(spark):
    docs = raw(spark, ("a.md", RICH.encode()), ("b.md", RICH.encode()), ("c.json", b"{}"), ("d.txt", b""))
    one, each = (sorted(parse(docs, once=x).collect(), key=lambda r: r["document_id"]) for x in (True, False))
    assert one == each


def test_parsing_and_spans_need_no_shuffle(spark):
    plan = build(raw(spark, ("a.md", RICH.encode()))).blocks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_equal_bytes_give_equal_artifacts_and_are_parsed_once(spark):
    result = build(raw(spark, ("a.md", RICH.encode()), ("b.md", RICH.encode())))
    a, b = sorted(result.artifacts.drop("document_id").collect(), key=str)
    assert a == b
    assert len({r["id"] for r in result.blocks.where("ordinal = 0").collect()}) == 1


def test_declared_type_is_only_a_claim(spark):
    df = spark.createDataFrame([("1", "x.md", "application/pdf", bytearray(b"# T"))], RAW)
    row = build(df).artifacts.first()
    assert row["media_type"] == "text/markdown" and row["warnings"][0]["code"] == "media_type_mismatch"
    assert row["metadata"]["char_count"] == len(row["text"]) and row["metadata"]["heading_count"] == 1


def test_no_documents(spark):
    result = build(spark.createDataFrame([], RAW))
    assert result.artifacts.count() == result.blocks.count() == result.pages.count() == result.failures.count() == 0


def test_registry_names_every_format():
    assert {name for name, _ in parsers.registry().values()} == {"text", "html", "csv", "docx", "xlsx", "image"}
