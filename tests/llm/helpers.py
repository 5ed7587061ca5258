"""Fixtures shared by the tests of the training-data operators."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Odd texts: white space of all kinds, special tokens, other scripts, very long words and texts.
ODD = [
    "", " ", "a  b", "hello world", None, "  lead", "trail  ", "\n\n x\n", "日本語 テキスト 梦", "ab\x00c \x01", "\U0001f600\U0001f603 a\U0001f600b", " " * 41, "x" * 300,
    "<s> </s> <unk> <0x41>", "a<|endoftext|> b <|startoftext|>c", "<|EndOfText|> x", "a▁b ▁ c", "tab\tsep", "e\u0301 \u0301 ñ", "thethethe The THE", "aaaa" * 50, "don't  we'll\tgo", "x\u00a0y\u2003z\u200b", "a\x1cb \x1d c", "İstanbul ΑΣ ΣΑΣ", "a \r\n b", " ".join(["ab"] * 3000), " a",
]


def documents(spark, rows):
    """Rows of (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def clashing(df):
    """The same rows with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("keep_id", "group_size", "row", "fp", "key", "root", "text_digest", "keep_key", "part", "host", "path", "p", "logit", "rank", "leaf", "id", "vector", "length", "start", "good_id")
    return df.select("*", *(F.lit("clash").alias(n) for n in names))
