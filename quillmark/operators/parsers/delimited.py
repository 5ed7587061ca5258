"""Delimited text: one table; the delimiter is found from the text."""

from __future__ import annotations

import csv
import io

from quillmark.errors import ParseFailure
from quillmark.functions.plain import decode, one_line
from quillmark.operators.parsers.outline import Block, Outline

#: Fixed values.
MAX_ROWS, MAX_COLUMNS, SNIFFED = 5000, 64, 8192
DELIMITERS = ",;\t|"


def delimiter_of(text: str) -> str:
    """By the csv module's sniffer; where it gives up, the candidate that the first line has most of."""
    try:
        return csv.Sniffer().sniff(text[:SNIFFED], delimiters=DELIMITERS).delimiter
    except csv.Error:
        head = text[:SNIFFED].partition("\n")[0]
        return max(DELIMITERS, key=head.count) if any(d in head for d in DELIMITERS) else ","


def parse(data: bytes) -> Outline:
    text, guess = decode(data)
    out = Outline("csv")
    if guess:
        out.warn(guess, "character encoding had to be guessed")
    if not text.strip():
        raise ParseFailure("corrupt", "the file contains no rows")
    delimiter = delimiter_of(text)
    rows, cut = [], False
    try:
        for n, row in enumerate(csv.reader(io.StringIO(text), delimiter=delimiter)):
            if n == MAX_ROWS:
                cut = True
                break
            cut |= len(row) > MAX_COLUMNS
            rows.append([one_line(x) for x in row[:MAX_COLUMNS]])
    except csv.Error as e:
        raise ParseFailure("corrupt", f"malformed CSV: {e}") from e
    rows = [r for r in rows if any(r)]
    if not rows:
        raise ParseFailure("corrupt", "the file contains no non-empty rows")
    width = max(map(len, rows))
    if cut:
        out.warn("rows_truncated", f"only the first {MAX_ROWS} rows and {MAX_COLUMNS} columns were read")
    if width == 1 and len(rows) > 1:
        out.warn("single_column", f"every row parsed as one column using delimiter {delimiter!r}; the file may use a delimiter this parser did not recognise")
    out.roots = [Block("table", rows=[r + [""] * (width - len(r)) for r in rows])]
    return out
