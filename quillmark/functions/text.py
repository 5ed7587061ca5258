"""Text functions on columns: JVM expressions throughout, but for NFKC, which Spark lacks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmark.functions import plain

_SPACE_CLASS = f"[{plain.SPACES}]"
#: What Python counts as white space: Java's White_Space and the separators U+001C to U+001F.
ANY_SPACE = "[\\s\\x1c-\\x1f\\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _one_blank(c: Column, space: str) -> Column:
    """Runs of ``space`` (a character class with the blank) become one blank.  A blank by itself, the commonest run by
    far, is no match, as replacing it would only copy it."""
    return F.regexp_replace(c, f"(?: {space}++|(?! ){space}++)", " ")



@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


_SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without the white space at both ends, all of it, not only blanks."""
    return F.trim(c, F.lit(_SPACE_CHARS))


def nfkc(c: Column) -> Column:
    return _nfkc(c)


def normalise(c: Column, compose: bool = True) -> Column:
    """Line ends to \\n, NFKC, invisible and control characters out.  compose=False leaves NFKC out, for text that is
    known to be composed; the expression is then free of Python."""
    c = F.regexp_replace(c, "\r\n?|\u2028|\u2029", "\n")
    c = nfkc(c) if compose else c
    return F.regexp_replace(F.translate(c, plain.INVISIBLE, ""), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")


def collapse_ws(c: Column) -> Column:
    """Runs of spaces within each line become one; lines are stripped."""
    lines = F.split(_one_blank(c, _SPACE_CLASS), "\n")
    return F.array_join(F.transform(lines, strip), "\n")


def clean_inline(c: Column, compose: bool = True) -> Column:
    return strip(_one_blank(F.replace(normalise(c, compose), F.lit("\n"), F.lit(" ")), _SPACE_CLASS))


def join_wrapped(c: Column) -> Column:
    """Lines of a paragraph become one; a word that a hyphen breaks over a line end is joined."""
    broken = F.regexp_like(c, F.lit(f"[-\u2010\u2011]{ANY_SPACE}*\n"))  # most texts have none, and the full pattern is slow
    c = F.when(~broken, c).otherwise(F.regexp_replace(c, f"(?U)(\\w)[-\u2010\u2011]{ANY_SPACE}*\n{ANY_SPACE}*(\\w)", "$1$2"))
    return strip(_one_blank(F.replace(c, F.lit("\n"), F.lit(" ")), _SPACE_CLASS))


def fold(c: Column) -> Column:
    """Text for comparison: quotes and dashes straightened, white space collapsed, lower case where the length stays."""
    marks = plain.SINGLE_QUOTES + plain.DOUBLE_QUOTES + plain.DASHES
    plain_marks = "'" * len(plain.SINGLE_QUOTES) + '"' * len(plain.DOUBLE_QUOTES) + "-" * len(plain.DASHES)
    # a capital sigma goes too, as its lower case must not depend on its neighbours; most texts have none of these, and
    # translate looks every character up
    marked = F.translate(c, marks + "\u03a3", plain_marks + "\u03c3")
    plainer = _one_blank(F.when(F.regexp_like(c, F.lit(f"[{marks}\u03a3]")), marked).otherwise(c), ANY_SPACE)
    # U+0130 is the one letter that lower() lengthens; asked of the text itself, so that each branch folds it once
    return F.when(~F.contains(c, F.lit("\u0130")), F.lower(plainer)).otherwise(F.array_join(F.transform(F.split(plainer, "\u0130", -1), F.lower), "\u0130"))


def word_count(c: Column) -> Column:
    """Words between white space, as a long."""
    return F.regexp_count(c, F.lit(f"[^{ANY_SPACE[1:]}+")).cast("long")


def tokens(folded: Column) -> Column:
    """Distinct runs of four or more ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(folded, F.lit("[a-z0-9]{4,}"), F.lit(0)))


def occurrences(haystack: Column, needle: Column) -> Column:
    """How often the needle stands in the text, overlaps counted, as a long."""
    quoted = F.concat(F.lit("(?s)(?=\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.regexp_count(haystack, quoted).cast("long")


def split_row(line: Column) -> Column:
    """Cells of a pipe-table row; an escaped pipe belongs to its cell."""
    row = F.regexp_replace(strip(line), "^\\|", "")
    row = F.regexp_replace(row, "(?<!\\\\)\\|$", "")
    return F.transform(F.split(row, "(?<!\\\\)\\|", -1), lambda x: strip(F.replace(x, F.lit("\\|"), F.lit("|"))))


def escape_cell(c: Column) -> Column:
    return strip(F.translate(F.replace(c, F.lit("|"), F.lit("\\|")), "\r\n", "  "))


def render_table(rows: Column, header_rows: Column | int = 1) -> Column:
    """A pipe table of rows of cells: padded to the widest row, its first row the header (blank if there is none)."""
    header_rows = F.lit(header_rows) if isinstance(header_rows, int) else header_rows
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), escape_cell), " | "), F.lit(" |"))
    blank = F.array(F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit(""), width), " | "), F.lit(" |")))
    rule = F.array(F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |")))
    lines = F.transform(rows, line)
    table = F.when(header_rows > 0, F.concat(F.slice(lines, 1, 1), rule, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))).otherwise(F.concat(blank, rule, lines))
    return F.when(F.size(rows) > 0, F.array_join(table, "\n")).otherwise("")


def has_markup(c: Column) -> Column:
    """Whether a line is a heading, a list item or a fence."""
    return F.regexp_like(c, F.lit("(?m)^#{1,6}[ \\t].*$|^[ \\t]*([-*+]|\\d{1,9}[.)])[ \\t].*$|^[ \\t]*(```+|~~~+)[ \\t]*[^\\s`~]*[ \\t]*$"))


@F.pandas_udf(StringType())
def block_id(content_hash: pd.Series, ordinal: pd.Series) -> pd.Series:
    return pd.Series([plain.block_id(h, int(o)) for h, o in zip(content_hash, ordinal, strict=True)], dtype="object")


@F.pandas_udf(StringType())
def options_hash(options: pd.Series) -> pd.Series:
    import json

    return options.map(lambda x: plain.options_hash(json.loads(x) if x else None))


def mask(c: Column) -> Column:
    """A secret for a log: its first and last four characters, if it has over eight; as ``config.masked``."""
    return F.when(F.length(c) > 8, F.concat(F.substring(c, 1, 4), F.lit("…"), F.right(c, F.lit(4)))).when(F.length(c) > 0, F.lit("***"))


def redact_url(c: Column) -> Column:
    """A URL with ``***`` in place of its user and password; as ``config.redacted``."""
    return F.regexp_replace(c, "^([a-zA-Z][a-zA-Z0-9+.-]*://).*@", "$1***@")
