import random

import pytest
from pyspark.sql import functions as F

from quillmark.config import masked, redacted

from quillmark.functions import plain
from quillmark.functions import text as T

CASES = [
    ("authenti-\ncation", plain.unwrap, T.join_wrapped, "authentication"),
    ("multi-\ntenant isolation", plain.unwrap, T.join_wrapped, "multitenant isolation"),
    ("opt - in", plain.unwrap, T.join_wrapped, "opt - in"),
    ("élève-\nà", plain.unwrap, T.join_wrapped, "élèveà"),
    ("300\u00a0ms", plain.normalise, T.normalise, "300 ms"),
    ("authen\u00adtication", plain.normalise, T.normalise, "authentication"),
    ("a\x00b\x07\nc", plain.normalise, T.normalise, "ab\nc"),
    ("a\r\nb\u2028c\u2029d", plain.normalise, T.normalise, "a\nb\nc\nd"),
    ("ﬁle", plain.normalise, T.normalise, "file"),
    ("  a\n  b\t\tc  ", plain.one_line, T.clean_inline, "a b c"),
]


@pytest.mark.parametrize("given,python,column,wanted", CASES)
def test_repairs_agree_in_both_forms(spark, given, python, column, wanted):
    assert python(given) == wanted
    assert spark.createDataFrame([(given,)], "t string").select(column(F.col("t"))).first()[0] == wanted


def test_fold_agrees_with_its_python_form_on_odd_text(spark):
    rng = random.Random(5)
    alphabet = "aB \t\n\u2019\u201c\u2014\u2026\u0130\u03a3\u03c3\u00df\u00a0\u3000\U0001f600\x1cX"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fold(F.col("t")).alias("f")).collect()
    assert all(r["f"] == plain.fold(r["t"])[0] for r in rows)


def test_fold_maps_back_to_the_original():
    folded, origin = plain.fold("The  “Platform”")
    assert folded == 'the "platform"' and origin[4] == 5 and len(origin) == len(folded)


@pytest.mark.parametrize("data,text,code", [(b"the \x93platform\x94", "the “platform”", "encoding_guessed"), (b"\xff\xfea\x00", "a", None), (b"\xef\xbb\xbfa", "a", None), (b"\x81\x93", "\x81\x93", "encoding_undetermined"), ("é".encode(), "é", None)])
def test_decode(data, text, code):
    assert plain.decode(data) == (text, code)


def test_overlapping_occurrences_and_escapes(spark):
    df = spark.createDataFrame([("aaaa", "aa", 3), ("a.b.c", ".", 2), ("x\\Ey\\E", "\\E", 2), ("none", "q", 0)], "h string, n string, want int")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.occurrences(F.col("h"), F.col("n"))).collect())


def test_table_round_trip(spark):
    rows = [["a", "b|c", ""], ["1", "x\ny"]]
    df = spark.createDataFrame([(rows,)], "rows array<array<string>>")
    text = df.select(T.render_table(F.col("rows"))).first()[0]
    assert text == "| a | b\\|c |  |\n| --- | --- | --- |\n| 1 | x y |  |"
    back = spark.createDataFrame([(text.split("\n")[0],)], "l string").select(T.split_row(F.col("l"))).first()[0]
    assert back == ["a", "b|c", ""]
    blank = df.select(T.render_table(F.col("rows"), 0)).first()[0]
    assert blank.startswith("|  |  |  |\n| --- |")
    assert spark.sql("SELECT cast(array() AS array<array<string>>) AS rows").select(T.render_table(F.col("rows"))).first()[0] == ""


def test_ids_and_option_hashes(spark):
    df = spark.createDataFrame([("h", 3, '{"b": 1, "a": 2}')], "h string, n int, o string")
    row = df.select(T.block_id("h", "n").alias("id"), T.options_hash("o").alias("o")).first()
    assert row["id"] == plain.block_id("h", 3) and len(row["id"]) == 16
    assert row["o"] == plain.options_hash({"a": 2, "b": 1}) and plain.options_hash({}) == ""


def test_markup_and_redaction(spark):
    df = spark.createDataFrame([("# a", True), ("x\n1) b", True), ("```py", True), ("plain - text", False), ("#no", False)], "t string, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", T.has_markup(F.col("t"))).collect())
    urls = ["https://u:p@h/x?a=1", "postgresql://role:secret@h/db", "https://h/x", ""]
    got = spark.createDataFrame([(u, s) for u, s in zip(urls, ["AKIA1234567890WXYZ", "short", "", "123456789"], strict=True)], "u string, s string")
    for r in got.withColumn("shown", T.redact_url(F.col("u"))).withColumn("masked", T.mask(F.col("s"))).collect():
        assert r["shown"] == (redacted(r["u"]) or "") and r["masked"] == masked(r["s"])
