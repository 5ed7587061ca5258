r"""Chat formatting by a compiled template, with a loss mask, and the reader of its output.

The template marks turns with control strings.  Control strings inside a text or a role are escaped: a backslash is
doubled and a control string gets a backslash before its first character and after it, so that none is left whole;
dropping each backslash that stands before another character gives the text back.

Turns are dealt out by conversation, sorted, and rendered and read as a stream: a conversation of any length takes the
memory of one turn and one part of ``PART`` characters.  (One conversation is one text, so one task writes it.)

Nulls: a null text or role is empty; rows of a null conv_id are one conversation; a null turn comes first.  Ties and
repeated rows stand in order of (turn, role, text), each as a turn of its own.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import numbered_partitions, table
from quillmark.llm.template import compile_template

#: Control strings: the template's own, and those of other common formats.
OPEN, CLOSE = "<|turn|>", "<|end|>"
CONTROLS = (OPEN, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for message in messages %}" + OPEN + "{{ message.role | escape_line }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}" + CLOSE + "\n{% endfor %}"
)
PART = 1 << 16

_control = re.compile("|".join(re.escape(x) for x in sorted(CONTROLS, key=len, reverse=True)))
_escaped = re.compile(r"\\(.)", re.S)
_line = re.compile(r"(?:[^\\\n]|\\.)*", re.S)
PART_TYPE = "conv_id long, part long, text string, learn array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return _control.sub(lambda m: "\\" + m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text) if "\\" in text else text


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in b.slice(lo, 256).columns), strict=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.string(), span)
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "part", "text", "learn"])


def rendered(template: str, conversations: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, part, text, spans under the loss mask): parts of a conversation follow one another."""
    render = compile_template(template, {"escape": escape, "escape_line": escape_line})
    for conv_id, rows in itertools.groupby(conversations, key=lambda r: r[0]):
        messages = ({"role": role or "", "text": text or ""} for _, role, text in rows)
        held: list[str] = []
        spans: list[dict] = []
        part = place = size = 0
        for text, learn in render(messages=messages):
            if size >= PART:
                yield conv_id, part, "".join(held), spans
                held, spans, size, part = [], [], 0, part + 1
            if learn and text:
                spans.append({"start": place, "end": place + len(text)})
            held.append(text)
            place, size = place + len(text), size + len(text)
        yield conv_id, part, "".join(held), spans


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted text of every conversation, in parts of about ``PART`` characters cut between strings of the
    template's output: conv_id, part (from 0), text, learn (spans of the whole text, in code points, under the loss
    mask).  Parts of a conversation stand together and in order."""

    def run(batches):
        held: list[tuple] = []
        size = 0
        for row in rendered(template, _rows(batches)):
            held.append(row)
            size += len(row[2])
            if size >= 1 << 21:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition(numbered_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, PART_TYPE)


class TurnReader:
    """Reads a formatted conversation part by part, back to roles and texts."""

    def __init__(self):
        self.turns = self.learn_chars = self.chars = 0
        self.all, self.learn = hashlib.sha256(), hashlib.sha256()
        self.state, self.role = "open", ""

    def feed(self, text: str, spans: list[dict]) -> None:
        for s in spans:
            own = unescape(text[s["start"] - self.chars : s["end"] - self.chars])
            self.learn_chars += len(own)
            self.learn.update(own.encode("utf-8", "surrogatepass"))
        self.chars += len(text)
        at = 0
        while at < len(text):
            if self.state == "open":
                if not text.startswith(OPEN, at):
                    raise ValueError("a turn is missing its mark")
                at += len(OPEN)
                self.state, self.role = "role", ""
            elif self.state == "role":
                m = _line.match(text, at)
                self.role += unescape(m[0])
                at = m.end()
                if at < len(text):  # the line's end
                    at += 1
                    self.state = "text"
                    self.all.update(f"{self.role}\n".encode("utf-8", "surrogatepass"))
            else:
                end = text.find(CLOSE + "\n", at)
                self.all.update(unescape(text[at : end if end >= 0 else len(text)]).encode("utf-8", "surrogatepass"))
                at = len(text)
                if end >= 0:
                    self.all.update(b"\n")
                    self.turns += 1
                    self.state, at = "open", end + len(CLOSE) + 1


def read_conversations(parts: DataFrame) -> DataFrame:
    """Digests of every formatted conversation, read back from its parts (which stand together and in order)."""

    def run(batches):
        out: list[tuple] = []
        for conv_id, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            reader = TurnReader()
            for _, _, text, spans in rows:
                reader.feed(text, spans)
            if reader.state != "open":
                raise ValueError(f"conversation {conv_id} is cut short")
            out.append((conv_id, reader.turns, reader.all.hexdigest(), reader.learn_chars, reader.learn.hexdigest(), reader.chars))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for lo in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) if x[0] is not None else pa.array(list(x), pa.int64()) for x in zip(*out[lo : lo + 10_000], strict=True)], names=names)

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{hard}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{hard}'")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_conversations(format_conversations(turns.unionByName(extra)))


_SQL_CONTROL = "|".join(re.escape(x).replace(r"\<", "<").replace("/", "/") for x in sorted(CONTROLS, key=len, reverse=True))
OP8_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) + 2 * len(regexp_extract_all(text, '{_SQL_CONTROL}'))
    + length(role) + length(role) - length(replace(role, chr(92), '')) + length(role) - length(replace(role, chr(10), '')) + 2 * len(regexp_extract_all(role, '{_SQL_CONTROL}'))
    + {len(OPEN) + 1 + len(CLOSE) + 1} AS n
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
