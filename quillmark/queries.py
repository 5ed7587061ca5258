"""The engine's queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import detect, layout, locate, lookup, serialise, serving
from quillmark.operators.parse import parse
from quillmark.plans import documents as plans
from quillmark.plans.store import kept
from quillmark.sources import files, jobs, refs
from quillmark.streaming import lifecycle as life

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-06-01 00:00:00'"
MIDDLE = "TIMESTAMP '2024-01-16 00:00:00'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scalars

_WRAP = r"regexp_replace(text, '([\p{L}\p{N}_])[-\x{2010}\x{2011}]\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g')"
_JOINED = rf"trim(regexp_replace(replace({_WRAP}, chr(10), ' '), '[ \t\x{{a0}}\x{{3000}}]+', ' ', 'g'))"
_FOLDED = "lower(regexp_replace(translate(text, chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(8212), '''''\"\"--'), '\\s+', ' ', 'g'))"


@query("SELECT doc_id, sha256(text) AS content_hash, CAST(octet_length(encode(text)) AS BIGINT) AS byte_size FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("byte_size"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    return d.where("n > 1")


@query(r"SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words FROM documents")
def word_char_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), T.word_count(F.col("text")).alias("words"))


@query(r"SELECT doc_id, regexp_replace(text, '\r\n?|\x{2028}|\x{2029}', chr(10), 'g') AS clean FROM documents")
def normalised_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalise(F.col("text")).alias("clean"))


@query(r"SELECT doc_id, array_to_string(regexp_split_to_array(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '\n'), chr(10)) AS collapsed FROM documents")
def collapse_ws_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_ws(F.col("text")).alias("collapsed"))


@query(f"SELECT doc_id, {_JOINED} AS joined FROM documents")
def join_wrapped_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.join_wrapped(F.col("text")).alias("joined"))


@query(f"SELECT doc_id, {_FOLDED} AS folded FROM documents")
def fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(f"SELECT DISTINCT doc_id, unnest(regexp_extract_all({_FOLDED}, '[a-z0-9]{{4,}}')) AS token FROM documents")
def text_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(T.fold(F.col("text")))).alias("token"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?m)^#{1,6}[ \t].*$|^[ \t]*([-*+]|[0-9]{1,9}[.)])[ \t].*$|^[ \t]*(```+|~~~+)[ \t]*[^\s`~]*[ \t]*$') AS markup FROM documents""")
def has_markup(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_markup(F.col("text")).alias("markup"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents),
b AS (SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, regexp_replace(regexp_replace(trim(line), '^\|', ''), '\|$', '') AS body FROM l WHERE contains(line, '|'))
SELECT doc_id, line_no, CAST(len(string_split(body, '|')) AS BIGINT) AS n_cells, trim(regexp_replace(body, '\s*\|\s*', '/', 'g')) AS cells FROM b""")
def pipe_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.contains("line", F.lit("|")))
    row = T.split_row(F.col("line"))
    return lines.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), F.size(row).cast("long").alias("n_cells"), F.array_join(row, "/").alias("cells"))


@query(r"""
SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS rendered
FROM nation GROUP BY n_regionkey""")
def render_table(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("rows", lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"])))
    return rows.select("n_regionkey", T.render_table(cells).alias("rendered"))


# ---------------------------------------------------------------- references and media types


@query(r"""
SELECT page_id, 'http' AS kind, url, regexp_replace(url, '[?#].*$', '') AS shown, nullif(regexp_extract(url, '[?&]versionId=([^&#]*)', 1), '') AS version_id FROM pages""")
def parse_ref(spark, sf_dir):
    r = table(spark, sf_dir, "pages").select("page_id", refs.parse_ref(F.col("url")).alias("r"))
    return r.select("page_id", F.col("r.kind").alias("kind"), F.col("r.url").alias("url"), refs.describe(F.col("r")).alias("shown"), F.col("r.version_id").alias("version_id"))


@query(r"""
SELECT o_orderkey, 's3' AS kind, 'bucket-' || o_custkey % 7 AS bucket, 'in/' || o_orderpriority || '/' || o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'v' || o_orderkey END AS version_id FROM orders""")
def parse_s3_ref(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.replace(F.concat(F.lit("in/"), F.col("o_orderpriority"), F.lit("/"), F.col("o_orderkey").cast("string")), F.lit(" "), F.lit("%20"))
    version = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("?versionId=v"), F.col("o_orderkey").cast("string"))).otherwise("")
    r = o.select("o_orderkey", refs.parse_ref(F.concat(F.lit(" s3://bucket-"), (F.col("o_custkey") % 7).cast("string"), F.lit("/"), key, version)).alias("r"))
    return r.select("o_orderkey", *(F.col(f"r.{c}").alias(c) for c in ("kind", "bucket", "key", "version_id")))


@query(r"""SELECT o_orderkey, 's3://main/docs/' || o_orderkey || '.txt' AS reference FROM orders""")
def resolve_reference(spark, sf_dir):
    n = F.col("o_orderkey").cast("string")
    given = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/"), n, F.lit(".txt"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("docs/"), n, F.lit(".txt"))).otherwise(F.concat(F.lit("s3://main/docs/"), n, F.lit(".txt")))
    return table(spark, sf_dir, "orders").select("o_orderkey", refs.resolve(given, "main", "docs/").alias("reference"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN NULL ELSE 'text/' || event_type END AS media_type FROM events")
def media_type_clean(spark, sf_dir):
    t = F.col("event_type")
    given = F.when(t == "click", F.lit(" binary/octet-stream ")).when(t == "view", "; charset=x").otherwise(F.concat(F.lit("Text/"), F.upper(t), F.lit(" ; charset=utf-8")))
    return table(spark, sf_dir, "events").select("event_id", refs.clean_media_type(given).alias("media_type"))


@query(r"""
SELECT event_id, CASE WHEN s = 404 THEN 'not_found' WHEN s IN (408, 429) OR s >= 500 THEN 'storage_unavailable' WHEN s >= 300 THEN 'access_denied' END AS failure
FROM (SELECT event_id, 200 + (event_id * 7) % 350 AS s FROM events)""")
def http_failures(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", refs.http_failure(200 + (F.col("event_id") * 7) % 350).alias("failure"))


@query(r"""
SELECT doc_id, CASE WHEN starts_with(text, '%PDF-') THEN 'application/pdf' WHEN starts_with(text, 'GIF87a') OR starts_with(text, 'GIF89a') THEN 'image/gif'
  WHEN starts_with(text, 'BM') THEN 'image/bmp' WHEN starts_with(text, '{\rtf') THEN 'application/rtf'
  WHEN doc_id % 4 = 0 THEN 'text/markdown' WHEN doc_id % 4 = 1 THEN 'text/csv' ELSE 'text/plain' END AS media_type FROM documents""")
def detect_media_type(spark, sf_dir):
    name = F.concat(F.lit("doc."), F.when(F.col("doc_id") % 4 == 0, "MD").when(F.col("doc_id") % 4 == 1, "csv").when(F.col("doc_id") % 4 == 2, "dat").otherwise("txt"))
    return table(spark, sf_dir, "documents").select("doc_id", detect.detect(F.encode("text", "UTF-8"), name).alias("media_type"))


# ---------------------------------------------------------------- parse and serialise


def _texts(spark: SparkSession, sf_dir: str, ids: bool = False) -> plans.Parsed:
    return plans.build(files.text_documents(spark, f"{sf_dir}/documents.parquet", "doc_id", "text", "txt"), ids=ids)


def _pages(spark: SparkSession, sf_dir: str, ids: bool = False) -> plans.Parsed:
    return plans.build(files.text_documents(spark, f"{sf_dir}/pages.parquet", "page_id", "html", "html"), ids=ids)


@query(f"SELECT CAST(doc_id AS VARCHAR) AS document_id, 0 AS ordinal, 'paragraph' AS type, 0 AS span_start, CAST(length({_JOINED}) AS INTEGER) AS span_end, sha256({_JOINED}) AS own_sha256 FROM documents")
def block_spans(spark, sf_dir):
    return _texts(spark, sf_dir).blocks.select("document_id", "ordinal", "type", "span_start", "span_end", F.sha2("own", 256).alias("own_sha256"))


@query(rf"""
SELECT CAST(doc_id AS VARCHAR) AS document_id, 'text' AS format, CAST(length({_JOINED}) AS BIGINT) AS char_count, CAST(len(regexp_extract_all(text, '\S+')) - len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]-\n[\p{{L}}\p{{N}}_]')) AS BIGINT) AS word_count,
  CAST(1 AS BIGINT) AS block_count, CAST(0 AS BIGINT) AS heading_count FROM documents""")
def document_metadata(spark, sf_dir):
    m = F.col("metadata")
    return _texts(spark, sf_dir).artifacts.select("document_id", m["format"].alias("format"), m["char_count"].alias("char_count"), m["word_count"].alias("word_count"), m["block_count"].alias("block_count"), m["heading_count"].alias("heading_count"))


@query()
def html_blocks(spark, sf_dir):
    return _pages(spark, sf_dir, ids=True).blocks.select("document_id", "ordinal", "id", "parent_id", "type", "depth", "span_start", "span_end", "own")


@query()
def html_text(spark, sf_dir):
    return _pages(spark, sf_dir).artifacts.select("document_id", "text", F.col("metadata.title").alias("title"), F.col("metadata.block_count").alias("blocks"))


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, 'application/json' AS media_type, 'unsupported_format' AS failure, 'no parser for application/json' AS reason FROM documents WHERE NOT regexp_matches(text, '^(%PDF-|GIF8|BM)') AND text <> ''")
def parse_failures(spark, sf_dir):
    raw = files.text_documents(spark, f"{sf_dir}/documents.parquet", "doc_id", "text", "json")
    return parse(raw).where("failure IS NOT NULL").select("document_id", "media_type", "failure", "reason")


@query(r"""
SELECT CAST(s_nationkey AS VARCHAR) AS document_id, CAST(1 + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS row_no, CAST(s_suppkey AS VARCHAR) AS a, s_name AS b, 'x, y' AS c FROM supplier""")
def csv_parse(spark, sf_dir):
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), F.col("s_name"), F.lit('"x, y"'))
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", line.alias("line")))).alias("lines"))
    text = F.concat(F.lit("key,name,note\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    none = F.lit(None).cast("string")
    raw = rows.select(F.col("s_nationkey").cast("string").alias("document_id"), F.lit("s.csv").alias("filename"), none.alias("declared_media_type"), F.encode(text, "UTF-8").alias("content"))
    cells = parse(raw).select("document_id", F.posexplode(F.col("blocks")[0]["rows"]).alias("at", "row")).where("at > 0")
    return cells.select("document_id", (F.col("at") + 1).alias("row_no"), F.col("row")[0].alias("a"), F.col("row")[1].alias("b"), F.col("row")[2].alias("c"))


# ---------------------------------------------------------------- structure of made documents


def _made(rows: DataFrame, key: str, content, extension: str) -> plans.Parsed:
    """Documents made of a table's rows, one for each."""
    none = F.lit(None).cast("string")
    raw = rows.select(F.col(key).cast("string").alias("document_id"), F.lit(f"made.{extension}").alias("filename"), none.alias("declared_media_type"), content.alias("content"))
    return plans.build(raw, ids=False)


def _blocks_sql(kinds: list[tuple[str, int, str]]) -> str:
    """SQL of the block table of a document for each supplier: (type, depth, own text as an SQL expression) in order."""
    one = "SELECT CAST(s_suppkey AS VARCHAR) AS document_id, CAST({} AS INTEGER) AS ordinal, '{}' AS type, CAST({} AS INTEGER) AS depth, {} AS own FROM supplier"
    return " UNION ALL ".join(one.format(i, kind, depth, own) for i, (kind, depth, own) in enumerate(kinds))


_KEY = "s_suppkey || ''"
_MARKDOWN = """# Supplier {k} #

Named  {n},
at home.
---

* first {k}
* second
    3) inner {n}

```sql
SELECT  {k}

;
```
| key | name |
|:--|---:|
| {k} | a\\|b |
End of the table.

***
### Last
~~~
{n}
~~~"""


@query(_blocks_sql([
    ("heading", 1, f"'# Supplier ' || {_KEY}"), ("paragraph", 0, "'Named ' || s_name || ', at home. ---'"), ("list", 0, "''"), ("list_item", 1, f"'- first ' || {_KEY}"), ("list_item", 1, "'- second'"), ("list", 0, "''"), ("list_item", 2, "'  3. inner ' || s_name"),
    ("code", 0, f"'```sql' || chr(10) || 'SELECT  ' || {_KEY} || chr(10) || chr(10) || ';' || chr(10) || '```'"), ("table", 0, f"'| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || {_KEY} || ' | a\\|b |'"),
    ("paragraph", 0, "'End of the table.'"), ("heading", 3, "'### Last'"), ("code", 0, "'```' || chr(10) || s_name || chr(10) || '```'"),
]))
def markdown_blocks(spark, sf_dir):
    text = F.replace(F.replace(F.lit(_MARKDOWN), F.lit("{k}"), F.col("s_suppkey").cast("string")), F.lit("{n}"), F.col("s_name"))
    return _made(table(spark, sf_dir, "supplier"), "s_suppkey", F.encode(text, "UTF-8"), "md").blocks.select("document_id", "ordinal", "type", "depth", "own")


_HTML = """<html><head><title>unseen</title><style>p {}</style></head><body><nav><p>skipped</p></nav><h1>Supplier &amp; {k}</h1>
<p>Named <b>{n}</b>,<br>at  home</p><div>loose {k}</div><ul><li>first {k}</li><li>second</li></ul><ol><li>only</li></ol>
<table><tr><th>key</th><th>name</th></tr><tr><td>{k}</td><td>a|b</td></tr><tr><td></td></tr></table><pre>x
  {n}</pre><script>gone()</script><h3>Last</h3><aside>skipped</aside><blockquote>said {n}</blockquote><footer>skipped</footer></body></html>"""


@query(_blocks_sql([
    ("heading", 1, f"'# Supplier & ' || {_KEY}"), ("paragraph", 0, "'Named ' || s_name || ', at home'"), ("paragraph", 0, f"'loose ' || {_KEY}"), ("list", 0, "''"), ("list_item", 1, f"'- first ' || {_KEY}"), ("list_item", 1, "'- second'"), ("list", 0, "''"), ("list_item", 1, "'1. only'"),
    ("table", 0, f"'| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || {_KEY} || ' | a\\|b |'"), ("code", 0, "'```' || chr(10) || 'x' || chr(10) || '  ' || s_name || chr(10) || '```'"), ("heading", 3, "'### Last'"), ("paragraph", 0, "'said ' || s_name"),
]))
def html_structure(spark, sf_dir):
    text = F.replace(F.replace(F.lit(_HTML), F.lit("{k}"), F.col("s_suppkey").cast("string")), F.lit("{n}"), F.col("s_name"))
    return _made(table(spark, sf_dir, "supplier"), "s_suppkey", F.encode(text, "UTF-8"), "html").blocks.select("document_id", "ordinal", "type", "depth", "own")


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS document_id, 'name ' || s_name || chr(10) || chr(10) || CASE WHEN s_suppkey % 4 = 3 THEN 'caf' || chr(233) || ' ' || chr(8364) ELSE 'fine ' || chr(233) || ' 10' END AS text,
  CASE WHEN s_suppkey % 4 = 3 THEN 'encoding_guessed' END AS warning FROM supplier""")
def decoded_text(spark, sf_dir):
    """UTF-16 and UTF-8 with a mark, plain UTF-8 and cp1252; a ligature, a soft hyphen and a zero-width space are repaired."""
    k = F.col("s_suppkey") % 4
    body = F.concat(F.lit("name "), F.col("s_name"), F.lit("\r\n\r\nﬁne​ é 1­0"))
    old = F.concat(F.encode(F.concat(F.lit("name "), F.col("s_name"), F.lit("\r\n\r\ncaf")), "UTF-8"), F.unhex(F.lit("E92080")))
    content = F.when(k == 0, F.encode(body, "UTF-16")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(body, "UTF-8"))).when(k == 2, F.encode(body, "UTF-8")).otherwise(old)
    found = _made(table(spark, sf_dir, "supplier"), "s_suppkey", content, "txt").artifacts
    return found.select("document_id", "text", F.get("warnings", F.lit(0))["code"].alias("warning"))


def _transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: a paragraph for each turn, two turns to a page."""
    turns = table(spark, sf_dir, "conversations")
    none = lambda kind: F.lit(None).cast(kind)
    block = F.struct(
        F.col("turn").cast("int").alias("ordinal"), none("int").alias("parent"), F.col("turn").cast("int").alias("last"), F.lit("paragraph").alias("type"), F.lit(0).alias("depth"), (F.col("turn") / 2 + 1).cast("int").alias("page"), F.col("text").alias("raw"),
        none("array<array<string>>").alias("rows"), none("int").alias("header_rows"), none("double").alias("confidence"), none("boolean").alias("ordered"), none("int").alias("number"), none("string").alias("lang"), F.lit(False).alias("first"),
    )
    docs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    return serialise.with_text(docs.select(F.col("conv_id").cast("string").alias("document_id"), F.lit("").alias("content_hash"), "blocks"))


_SPANS = """
WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INTEGER) AS ordinal, CAST(floor(turn / 2) + 1 AS INTEGER) AS page, length(text) AS n,
  sum(length(text) + CASE WHEN turn = 0 THEN 0 ELSE 2 END) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations),
spans AS (SELECT document_id, ordinal, page, CAST(e - n AS INTEGER) AS span_start, CAST(e AS INTEGER) AS span_end FROM s),
whole AS (SELECT document_id, max(span_end) AS size FROM spans GROUP BY document_id),
offsets AS (SELECT document_id, CAST(o AS INTEGER) AS "offset" FROM (SELECT document_id, unnest(range(0, size + 50, 97)) AS o FROM whole)),
pages_ AS (SELECT document_id, page, min(span_start) AS ps, max(span_end) AS pe FROM spans WHERE span_end > span_start GROUP BY document_id, page)
"""


@query("SELECT CAST(conv_id AS VARCHAR) AS document_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def conversation_transcript(spark, sf_dir):
    return _transcript(spark, sf_dir).select("document_id", "text")


@query(_SPANS + "SELECT document_id, ordinal, page, span_start, span_end FROM spans")
def turn_spans(spark, sf_dir):
    return serialise.block_table(_transcript(spark, sf_dir), ids=False).select("document_id", "ordinal", "page", "span_start", "span_end")


@query(_SPANS + "SELECT document_id, page AS number, ps AS span_start, pe AS span_end, pe - ps AS char_count, 'text_layer' AS source FROM pages_")
def page_spans(spark, sf_dir):
    return serialise.page_table(serialise.block_table(_transcript(spark, sf_dir), ids=False)).drop("confidence")


def _offsets(texts: DataFrame) -> DataFrame:
    return texts.select("document_id", F.explode(F.sequence(F.lit(0), F.length("text") + 49, F.lit(97))).alias("offset"))


@query(_SPANS + 'SELECT o.document_id, o."offset", s.ordinal AS block_ordinal FROM offsets o LEFT JOIN spans s ON s.document_id = o.document_id AND s.span_start <= o."offset" AND o."offset" < s.span_end')
def block_at(spark, sf_dir):
    texts = _transcript(spark, sf_dir)
    return lookup.block_at(_offsets(texts), serialise.block_table(texts, ids=False))


@query(_SPANS + 'SELECT o.document_id, o."offset", min(p.page) AS page FROM offsets o LEFT JOIN pages_ p ON p.document_id = o.document_id AND p.ps <= o."offset" AND o."offset" < p.pe GROUP BY o.document_id, o."offset"')
def page_at(spark, sf_dir):
    texts = _transcript(spark, sf_dir)
    return lookup.page_at(_offsets(texts), serialise.page_table(serialise.block_table(texts, ids=False)))


@query(r"""
SELECT 'd' AS document_id, CAST(100000 * (r_regionkey + 1) AS BIGINT) AS ordinal, r_name AS path FROM region
UNION ALL SELECT 'd', CAST(100000 * (n_regionkey + 1) + 1000 * (n_nationkey + 1) AS BIGINT), r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'd', 10000000 + s_suppkey, r_name || ' > ' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def heading_path(spark, sf_dir):
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    top = region.select((100000 * (F.col("r_regionkey") + 1)).cast("long").alias("ordinal"), F.lit(None).cast("long").alias("parent"), F.lit("heading").alias("type"), F.concat(F.lit("# "), "r_name").alias("own"))
    at = lambda key, region_key: (100000 * (F.col(region_key) + 1) + 1000 * (F.col(key) + 1)).cast("long")
    mid = nation.select(at("n_nationkey", "n_regionkey").alias("ordinal"), (100000 * (F.col("n_regionkey") + 1)).cast("long").alias("parent"), F.lit("heading").alias("type"), F.concat(F.lit("## "), "n_name").alias("own"))
    low = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select((10000000 + F.col("s_suppkey")).cast("long").alias("ordinal"), at("n_nationkey", "n_regionkey").alias("parent"), F.lit("paragraph").alias("type"), F.col("s_name").alias("own"))
    found = lookup.heading_path(top.unionByName(mid).unionByName(low).withColumn("document_id", F.lit("d")))
    return found.select("document_id", "ordinal", F.array_join("path", " > ").alias("path"))


# ---------------------------------------------------------------- locate

_NEEDLE = _FOLDED.replace("text", "trim(text)")


@query(f"""
WITH q AS (SELECT item_id AS quote_id, {_NEEDLE} AS needle FROM benchmark WHERE length(trim(text)) >= 8), d AS (SELECT doc_id AS document_id, {_FOLDED} AS folded FROM documents)
SELECT quote_id, document_id, CAST(strpos(folded, needle) - 1 AS BIGINT) AS position,
  CAST(len(list_filter(range(1, length(folded) - length(needle) + 2), lambda i: substr(folded, i, length(needle)) = needle)) AS BIGINT) AS occurrences
FROM q JOIN d ON contains(folded, needle)""")
def locate_exact(spark, sf_dir):
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return locate.locate_corpus(quotes, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"))


@query(f"""
WITH q AS (SELECT item_id, 1 + item_id % 7 AS cut, text FROM benchmark)
SELECT item_id, CASE WHEN length(trim(left(text, cut * 2))) < 8 THEN 'too short to be a citation (' || length(trim(left(text, cut * 2))) || ' chars); quote at least 8' END AS reason FROM q""")
def quote_gate(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", F.expr("left(text, CAST((1 + item_id % 7) * 2 AS INT))").alias("quote"))
    return locate.gate(q).select("item_id", "reason")


def _turn_quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A changed sentence of each assistant turn as a quote, and the blocks to find it in."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant' AND length(text) >= 60")
    quote = F.concat(F.substring("text", 1, 25), F.lit("q"), F.expr("substring(text, 27, 34)"))
    return turns.select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("quote_idx"), quote.alias("quote")), _transcript(spark, sf_dir)


@query(rf"""
WITH b AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INTEGER) AS ordinal, unnest(list_distinct(regexp_extract_all({_FOLDED}, '[a-z0-9]{{4,}}'))) AS token FROM conversations),
q AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INTEGER) AS quote_idx, substr(text, 1, 25) || 'q' || substr(text, 27, 34) AS text FROM conversations WHERE role = 'assistant' AND length(text) >= 60),
t AS (SELECT document_id, quote_idx, unnest(list_distinct(regexp_extract_all({_NEEDLE}, '[a-z0-9]{{4,}}'))) AS token FROM q),
c AS (SELECT document_id, quote_idx, ordinal, count(*) AS shared FROM t JOIN b USING (document_id, token) GROUP BY document_id, quote_idx, ordinal),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id, quote_idx ORDER BY shared DESC, ordinal) AS n FROM c)
SELECT document_id, quote_idx, ordinal, shared FROM r WHERE n <= 40""")
def locate_candidates(spark, sf_dir):
    quotes, texts = _turn_quotes(spark, sf_dir)
    blocks = texts.select("document_id", F.explode("blocks").alias("b")).select("document_id", F.col("b.ordinal").alias("ordinal"), T.fold(F.col("b.own")).alias("hay"))
    needles = locate.gate(quotes).where("reason IS NULL").where(F.size(T.tokens(F.col("needle"))) > 0)
    return locate.candidates(needles, blocks)


@query()
def locate_quotes(spark, sf_dir):
    quotes, texts = _turn_quotes(spark, sf_dir)
    texts = kept(texts, "transcripts")
    blocks = kept(serialise.block_table(texts), "turns")
    return locate.locate(quotes, texts.select("document_id", "text"), blocks, serialise.page_table(blocks))


@query("""
WITH d AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY conv_id),
q AS (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations),
f AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INTEGER) AS quote_idx, CASE WHEN length(t) >= 8 THEN t END AS text, CAST(strpos(whole, t) - 1 AS INTEGER) AS pos FROM q JOIN d USING (conv_id))
SELECT document_id, quote_idx, CASE WHEN text IS NULL THEN 'none' ELSE 'exact' END AS match, CASE WHEN text IS NOT NULL THEN pos END AS span_start, CAST(pos + length(text) AS INTEGER) AS span_end, sha256(text) AS text_sha256 FROM f""")
def locate_turns(spark, sf_dir):
    """Every turn as a quote, whole, in its conversation."""
    quotes = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("quote_idx"), F.col("text").alias("quote"))
    texts = kept(_transcript(spark, sf_dir), "transcripts")
    blocks = kept(serialise.block_table(texts), "turns")
    found = locate.locate(quotes, texts.select("document_id", "text"), blocks, serialise.page_table(blocks))
    return found.select("document_id", "quote_idx", "match", "span_start", "span_end", F.sha2("text", 256).alias("text_sha256"))


# ---------------------------------------------------------------- layout

_LINES = """
WITH lines AS (SELECT l_orderkey % 200 AS document_id, CAST(l_linenumber AS INTEGER) AS page, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS seq, 'line ' || l_partkey AS text,
  CASE WHEN l_orderkey % 40 = 3 THEN 8.0 + floor(l_quantity / 10) * 3 ELSE 10.0 END AS size, l_partkey % 50 * 1.0 AS indent, 300.0 AS "right", 700.0 - l_orderkey % 97 * 7 AS top, 690.0 - l_orderkey % 97 * 7 AS bottom FROM lineitem)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    size = F.when(F.col("l_orderkey") % 40 == 3, 8.0 + F.floor(F.col("l_quantity") / 10) * 3).otherwise(10.0).cast("double")
    return li.select(
        (F.col("l_orderkey") % 200).alias("document_id"), F.col("l_linenumber").cast("int").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("line "), F.col("l_partkey").cast("string")).alias("text"),
        size.alias("size"), (F.col("l_partkey") % 50).cast("double").alias("indent"), F.lit(300.0).alias("right"), (700.0 - F.col("l_orderkey") % 97 * 7).cast("double").alias("top"), (690.0 - F.col("l_orderkey") % 97 * 7).cast("double").alias("bottom"), F.lit(None).cast("double").alias("confidence"),
    )


_BODY = ", c AS (SELECT document_id, round(size, 1) AS body_size, sum(length(text)) AS chars, min(CAST(page AS BIGINT) * 1000000000 + seq) AS f FROM lines GROUP BY document_id, round(size, 1)), body AS (SELECT document_id, arg_min(body_size, (-chars, f)) AS body_size FROM c GROUP BY document_id)"


@query(_LINES + _BODY + "SELECT document_id, body_size FROM body")
def pdf_body_size(spark, sf_dir):
    return layout.body_size(_lines(spark, sf_dir))


@query(_LINES + _BODY + "SELECT document_id, array_to_string(list_sort(list(DISTINCT CAST(size AS INTEGER)), 'DESC')[1:6], '/') AS tiers FROM lines JOIN body USING (document_id) WHERE size >= 1.18 * body_size AND length(text) <= 120 GROUP BY document_id")
def pdf_heading_tiers(spark, sf_dir):
    t = layout.heading_tiers(_lines(spark, sf_dir))
    return t.select("document_id", F.array_join(F.transform("tiers", lambda x: x.cast("int").cast("string")), "/").alias("tiers"))


_GAPS = _LINES + """, g AS (SELECT document_id, page, seq, top, bottom, lag(page) OVER w AS pp, lag(bottom) OVER w AS pb, CASE WHEN lead(page) OVER w = page THEN lead(bottom) OVER w - top END AS gap FROM lines WINDOW w AS (PARTITION BY document_id ORDER BY page, seq)),
t AS (SELECT document_id, coalesce(quantile_cont(CASE WHEN gap > 0 THEN gap END, 0.5) * 1.6 + 0.5, CAST('inf' AS DOUBLE)) AS threshold FROM g GROUP BY document_id)"""


@query(_GAPS + "SELECT document_id, round(threshold, 6) AS threshold FROM t")
def pdf_gap_threshold(spark, sf_dir):
    return layout.gap_threshold(_lines(spark, sf_dir)).select("document_id", F.round("threshold", 6).alias("threshold"))


@query(_GAPS + "SELECT document_id, page, seq, CAST(sum(CASE WHEN pp <> page OR pb - top > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY page, seq) AS BIGINT) AS paragraph FROM g JOIN t USING (document_id)")
def pdf_paragraphs(spark, sf_dir):
    return layout.paragraphs(_lines(spark, sf_dir)).select("document_id", "page", "seq", "paragraph")


_TABLES = """, boxes AS (SELECT document_id, page, 400.0 + document_id % 100 AS tt, 300.0 - document_id % 100 AS tb, 10.0 AS tl, 200.0 AS tr FROM (SELECT DISTINCT document_id, page FROM lines) WHERE page % 2 = 0)"""


@query(_LINES + _TABLES + "SELECT document_id, page, seq FROM lines l WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.document_id = l.document_id AND b.page = l.page AND (l.top + l.bottom) / 2 BETWEEN tb - 1 AND tt + 1 AND l.\"right\" >= tl - 2 AND l.indent <= tr + 2)")
def pdf_table_overlap(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    d = F.col("document_id") % 100
    boxes = lines.select("document_id", "page").distinct().where("page % 2 = 0").select("document_id", "page", (400.0 + d).alias("top"), (300.0 - d).alias("bottom"), F.lit(10.0).alias("left"), F.lit(200.0).alias("right"))
    return layout.outside_tables(lines, boxes).select("document_id", "page", "seq")


@query(_LINES + ", p AS (SELECT document_id, page, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines GROUP BY document_id, page) SELECT document_id, page, chars, CASE WHEN chars < 80 AND document_id % 3 > 0 THEN 'ocr' ELSE 'text_layer' END AS decision FROM p")
def pdf_ocr_decision(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    images = lines.select("document_id", "page").distinct().withColumn("n_images", F.col("document_id") % 3)
    return layout.ocr_decision(lines, images)


@query()
def pdf_structure(spark, sf_dir):
    return layout.structure(_lines(spark, sf_dir))


@query(r"""
WITH w AS (SELECT l_orderkey % 300 AS document_id, 1 AS page, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS idx, 'w' || l_partkey AS text, CASE WHEN l_linenumber = 5 THEN -1.0 ELSE l_quantity * 2 END AS conf,
  CAST(l_orderkey % 3 AS INTEGER) AS block_num, CAST(l_orderkey % 5 AS INTEGER) AS par_num, CAST(l_linenumber AS INTEGER) AS line_num, l_partkey % 90 * 1.0 AS x, l_suppkey % 70 * 1.0 AS y FROM lineitem)
SELECT document_id, page, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY idx, text) AS text, round(avg(CASE WHEN conf <> -1 THEN conf END) / 100, 6) AS confidence, min(x) AS "left", max(x + 12) AS "right"
FROM w WHERE conf = -1 OR conf >= 30 GROUP BY document_id, page, block_num, par_num, line_num""")
def ocr_group_lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    words = li.select(
        (F.col("l_orderkey") % 300).alias("document_id"), F.lit(1).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), F.when(F.col("l_linenumber") == 5, -1.0).otherwise(F.col("l_quantity") * 2).alias("conf"),
        (F.col("l_orderkey") % 3).cast("int").alias("block_num"), (F.col("l_orderkey") % 5).cast("int").alias("par_num"), F.col("l_linenumber").alias("line_num"), (F.col("l_partkey") % 90).cast("double").alias("left"), (F.col("l_suppkey") % 70).cast("double").alias("top"), F.lit(12.0).alias("width"), F.lit(9.0).alias("height"),
    )
    return layout.ocr_lines(words).select("document_id", "page", "block_num", "par_num", "line_num", "text", F.round("confidence", 6).alias("confidence"), "left", "right")


# ---------------------------------------------------------------- jobs and lifecycle


def _event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload events made of ``events``: clicks lack a key, views a tenant, errors are no JSON."""
    e = table(spark, sf_dir, "events")
    n, t = F.col("event_id").cast("string"), F.col("event_type")
    payload = F.to_json(F.struct(
        F.concat(F.lit("e"), n).alias("event_id"), F.concat(F.lit("doc-"), n).alias("document_id"), F.when(t == "view", "  ").otherwise(F.concat(F.lit("t"), F.col("user_id").cast("string"))).alias("tenant_id"), F.lit("uploads").alias("s3_bucket"),
        F.when(t != "click", F.concat(F.lit("/raw/"), n, F.lit(".pdf"))).alias("s3_key"), F.when(F.col("event_id") % 2 == 0, F.lit("report.pdf")).alias("filename"), F.when(F.col("event_id") % 3 == 0, n).otherwise("big").alias("size"),
    ))
    return e.select(n.alias("key"), F.when(t == "error", F.lit("not json")).otherwise(payload).cast("binary").alias("value"), F.lit(jobs.TOPIC_REQUESTED).alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"))


@query("""
SELECT event_id AS "offset", 'doc-' || event_id AS document_id, 's3://uploads/raw/' || event_id || '.pdf' AS reference, 't' || user_id AS tenant_id, CASE WHEN event_id % 2 = 0 THEN 'report.pdf' ELSE event_id || '.pdf' END AS filename,
  CASE WHEN event_id % 3 = 0 THEN event_id END AS size, 'e' || event_id AS trace_id FROM events WHERE event_type IN ('signup', 'purchase')""")
def event_job_map(spark, sf_dir):
    good = jobs.jobs(_event_messages(spark, sf_dir)).where("error IS NULL")
    return good.select("offset", *(F.col(f"job.{c}").alias(c) for c in ("document_id", "reference", "tenant_id", "filename", "size", "trace_id")))


@query("""
SELECT event_id AS "offset", CASE event_type WHEN 'error' THEN 'message is not a JSON object' WHEN 'click' THEN 'event is missing required field(s): s3_key' ELSE 'event is missing required field(s): tenant_id' END AS error
FROM events WHERE event_type IN ('error', 'click', 'view')""")
def event_missing_fields(spark, sf_dir):
    return jobs.jobs(_event_messages(spark, sf_dir)).where("error IS NOT NULL").select("offset", "error")


@query("""
SELECT 'documents.parse.dlq' AS topic, CAST(event_id AS VARCHAR) AS key, 'malformed_event' AS failure_class, event_type <> 'error' AS is_json FROM events WHERE event_type IN ('error', 'click', 'view')""")
def dead_letter_queue(spark, sf_dir):
    d = jobs.dead_letters(jobs.jobs(_event_messages(spark, sf_dir)))
    return d.select("topic", "key", F.col("headers")["failure_class"].alias("failure_class"), (F.col("value").cast("string") != "not json").alias("is_json"))


_FAILURES = "['corrupt', 'encrypted', 'storage_unavailable', 'fetch_timeout', 'internal', 'not_found']"


@query(f"""
WITH f AS (SELECT event_id, {_FAILURES}[CAST(1 + event_id % 6 AS INTEGER)] AS failure, CAST(1 + user_id % 4 AS INTEGER) AS attempt FROM events), r AS (SELECT *, failure IN ('storage_unavailable', 'fetch_timeout', 'internal') AS transient FROM f)
SELECT event_id, CASE WHEN transient AND attempt <= 3 THEN ['documents.parse.retry.30s', 'documents.parse.retry.5m', 'documents.parse.retry.30m'][attempt] ELSE 'documents.parse.dlq' END AS topic,
  CASE WHEN transient AND attempt > 3 THEN 'transient_exhausted' ELSE failure END AS failure_class, CASE WHEN transient AND attempt <= 3 THEN [30, 300, 1800][attempt] END AS delay_seconds FROM r""")
def failure_routing(spark, sf_dir):
    from quillmark.errors import is_transient

    names = F.array(*map(F.lit, ("corrupt", "encrypted", "storage_unavailable", "fetch_timeout", "internal", "not_found")))
    e = table(spark, sf_dir, "events").select("event_id", F.get(names, (F.col("event_id") % 6).cast("int")).alias("failure"), (1 + F.col("user_id") % 4).cast("int").alias("attempt"))
    return e.select("event_id", jobs.route(F.col("failure"), F.col("attempt"), is_transient(F.col("failure"))).alias("r")).select("event_id", "r.*")


@query(f"SELECT event_id FROM events WHERE user_id % 5 = 0 OR ts <= {MIDDLE}")
def due_jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.struct(F.when(F.col("user_id") % 5 != 0, F.col("ts")).alias("not_before")).alias("job"))
    return jobs.due(e, F.expr(MIDDLE)).select("event_id")


_STATUS = "['pending', 'processing', 'ready', 'failed', 'deleted']"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control rows made of ``orders``: a status by key, a result for the ready ones, tenants by customer."""
    key = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, ("pending", "processing", "ready", "failed", "deleted"))), (key % 5).cast("int"))
    at, none = F.col("o_orderdate"), F.lit(None).cast("string")
    values = {
        "id": key.cast("string"), "tenant_id": F.concat(F.lit("t"), (F.col("o_custkey") % 50).cast("string")), "status": status, "source_uri": F.when(key % 4 > 0, F.concat(F.lit("s3://b/"), key.cast("string"))), "byte_size": F.when(key % 3 == 0, key), "current_run_id": F.when(key % 5 == 2, F.concat(F.lit("r"), key.cast("string"))),
        "created_at": at, "updated_at": at, "deleted_at": F.when(key % 5 == 4, at),
    }
    kinds = dict(x.split() for x in life.DOCUMENTS.split(", "))
    return table(spark, sf_dir, "orders").select(*(values.get(c, none).cast(kinds[c]).alias(c) for c in kinds))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs made of ``orders``: succeeded for ready documents, running for those in work, failed for the failed."""
    key, none = F.col("o_orderkey"), F.lit(None).cast("string")
    status = F.when(key % 5 == 2, "succeeded").when(key % 5 == 1, "running").otherwise("failed")
    values = {
        "id": F.concat(F.lit("r"), key.cast("string")), "document_id": key.cast("string"), "content_hash": F.concat(F.lit("h"), key.cast("string")), "parser_version": F.lit("1.0"), "parse_options_hash": F.lit(""), "status": status, "artifact_key": F.when((key % 5 == 2) & (key % 7 > 0), F.concat(F.lit("parsed/"), key.cast("string"))),
        "attempt": F.lit(1), "lease_expires_at": F.col("o_orderdate"), "started_at": F.when(key % 5 != 3, F.col("o_orderdate")),
    }
    kinds = dict(x.split() for x in life.RUNS.split(", "))
    return table(spark, sf_dir, "orders").where("o_orderkey % 5 IN (1, 2, 3)").select(*(values.get(c, none).cast(kinds[c]).alias(c) for c in kinds))


_PIVOT = "TIMESTAMP '1997-01-01 00:00:00'"


@query("SELECT doc_key AS document_id, first_line FROM (SELECT CAST(l_orderkey AS VARCHAR) AS doc_key, CAST(min(l_linenumber) AS INTEGER) AS first_line FROM lineitem GROUP BY l_orderkey)")
def claim_first(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_linenumber").alias("offset")).dropDuplicates(["document_id", "offset"])
    return life.first_claims(li).select("document_id", F.col("offset").alias("first_line"))


@query("SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id, l_orderkey % 5 IN (0, 3) AS claimed, CASE l_orderkey % 5 WHEN 1 THEN 'status is processing' WHEN 2 THEN 'status is ready' WHEN 4 THEN 'deleted' END AS reason FROM lineitem")
def claim_documents(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"))
    return life.claim(_documents(spark, sf_dir), ids, F.expr(NOW))[1]


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, coalesce(['pending', 'processing', 'ready', 'failed', 'deleted'][CAST(1 + o_orderkey % 5 AS INTEGER)], 'pending') AS status, CASE WHEN o_orderkey % 4 > 0 THEN 's3://b/' || o_orderkey WHEN o_orderkey % 2 = 0 THEN 'new' END AS source_uri FROM orders
UNION ALL SELECT 'n' || o_orderkey, 'pending', 'new' FROM orders WHERE o_orderkey % 2 = 0""")
def register_documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    none = F.lit(None).cast("string")
    new = o.select(F.explode(F.array(F.col("o_orderkey").cast("string"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")))).alias("document_id"), none.alias("tenant_id"), none.alias("project_id"), F.lit("new").alias("reference"), none.alias("media_type"), F.lit(None).cast("long").alias("size"), F.col("o_orderkey").alias("offset"))
    return life.register(_documents(spark, sf_dir), new, F.expr(NOW)).select("id", "status", "source_uri")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CAST(CASE WHEN o_orderkey % 5 IN (1, 3) THEN 2 ELSE 1 END AS INTEGER) AS attempt FROM orders WHERE NOT (o_orderkey % 5 = 2) AND NOT (o_orderkey % 5 = 1 AND o_orderdate > {_PIVOT})")
def run_unique(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), F.lit("t").alias("tenant_id"), F.concat(F.lit("h"), F.col("o_orderkey").cast("string")).alias("content_hash"), F.lit("1.0").alias("parser_version"), F.lit("").alias("parse_options_hash"), F.lit(None).cast("string").alias("trace_id"))
    return life.start_runs(_runs(spark, sf_dir), d, F.expr(_PIVOT))[1].select("document_id", "attempt")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 1 AND o_orderdate <= {_PIVOT} THEN 'pending' ELSE {_STATUS}[CAST(1 + o_orderkey % 5 AS INTEGER)] END AS status FROM orders")
def lease_expired(spark, sf_dir):
    return life.reclaim_expired(_documents(spark, sf_dir), _runs(spark, sf_dir), F.expr(_PIVOT))[0].select("id", "status")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 1 THEN 'ready' ELSE {_STATUS}[CAST(1 + o_orderkey % 5 AS INTEGER)] END AS status, CASE WHEN o_orderkey % 5 IN (1, 2) THEN 'r' || o_orderkey END AS current_run_id FROM orders")
def complete_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    done = runs.where("status = 'running'").select("id", F.lit("parsed/x").alias("artifact_key"), "content_hash")
    return life.complete_runs(_documents(spark, sf_dir), runs, done, F.expr(NOW))[0].select("id", "status", "current_run_id")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'pending' END ELSE {_STATUS}[CAST(1 + o_orderkey % 5 AS INTEGER)] END AS status, CASE WHEN o_orderkey % 5 = 1 THEN 'corrupt' END AS failure_class FROM orders")
def fail_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    bad = runs.where("status = 'running'").select("document_id", F.col("id").alias("run_id"), F.lit("corrupt").alias("failure_class"), F.lit("broken").alias("failure_reason"), (F.col("document_id").cast("long") % 2 == 0).alias("final"))
    return life.fail_runs(_documents(spark, sf_dir), runs, bad, F.expr(NOW))[0].select("id", "status", "failure_class")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 4 THEN 'deleted' ELSE {_STATUS}[CAST(1 + o_orderkey % 5 AS INTEGER)] END AS status FROM orders")
def delete_documents(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("document_id"))
    return life.mark_deleted(_documents(spark, sf_dir), ids, F.expr(NOW)).select("id", "status")


@query("""
WITH m(old, moves) AS (VALUES ('pending', ['processing', 'failed', 'deleted']), ('processing', ['ready', 'failed', 'deleted']), ('ready', ['processing', 'ready', 'deleted']), ('failed', ['processing', 'deleted']), ('deleted', []::VARCHAR[])),
s(new) AS (VALUES ('pending'), ('processing'), ('ready'), ('failed'), ('deleted')) SELECT old, new, list_contains(moves, new) AS allowed FROM m, s""")
def status_moves(spark, sf_dir):
    states = F.array(*map(F.lit, life.MOVES))
    pairs = spark.range(1).select(F.explode(states).alias("old")).select("old", F.explode(states).alias("new"))
    return pairs.select("old", "new", life.may_move(F.col("old"), F.col("new")).alias("allowed"))


# ---------------------------------------------------------------- serving


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {_STATUS}[CAST(1 + o_orderkey % 5 AS INTEGER)] AS status, o_orderkey % 5 = 2 AS readable, CASE WHEN o_orderkey % 5 = 4 THEN 410 ELSE 200 END AS code FROM orders")
def status_projection(spark, sf_dir):
    return serving.status(_documents(spark, sf_dir)).select("id", "status", "readable", "code")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS id, {_STATUS}[CAST(1 + o_orderkey % 5 AS INTEGER)] AS status FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 8, 13)")
def batch_status(spark, sf_dir):
    return serving.batch_status(_documents(spark, sf_dir), "1, 2,3,5,8,13,2,none").select("id", "status")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 'r' || o_orderkey AS id, o_orderdate AS started_at FROM orders WHERE o_orderkey % 5 IN (1, 2)")
def runs_history(spark, sf_dir):
    return serving.runs_history(_runs(spark, sf_dir).where("started_at IS NOT NULL")).select("document_id", "id", "started_at")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 't7' AS tenant_id FROM orders WHERE o_custkey % 50 = 7")
def tenant_scope(spark, sf_dir):
    return serving.scoped(_documents(spark, sf_dir), "t7", required=True).select("id", "tenant_id")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 2 THEN '"h' || o_orderkey || ':1.0"' END AS etag,
  CASE WHEN o_orderkey % 5 = 4 THEN 410 WHEN o_orderkey % 5 <> 2 THEN 409 WHEN o_orderkey % 7 = 0 THEN 500 ELSE 200 END AS code FROM orders""")
def current_pointer(spark, sf_dir):
    return serving.current(_documents(spark, sf_dir), _runs(spark, sf_dir)).select("id", "etag", "code")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 4 > 0 THEN 202 ELSE 409 END AS code FROM orders WHERE o_orderkey % 5 <> 4")
def reprocess_requests(spark, sf_dir):
    return serving.reprocess(_documents(spark, sf_dir), required=False).select("id", "code")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256({_JOINED}) AS text_sha256, CAST(1 AS BIGINT) AS n_blocks FROM documents")
def served_content(spark, sf_dir):
    c = serving.content(_texts(spark, sf_dir).artifacts, "text,blocks")
    return c.select("document_id", F.sha2("text", 256).alias("text_sha256"), F.size("blocks").cast("long").alias("n_blocks"))


@query("""
WITH s AS (SELECT conv_id, turn, length(text) + CASE WHEN turn = 0 THEN 0 ELSE 2 END AS n, CAST(floor(turn / 2) AS INTEGER) AS p FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(sum(n) AS BIGINT) AS chars, CAST(count(DISTINCT p) AS INTEGER) AS pages, round(sum(n) / count(DISTINCT p), 6) AS chars_per_page FROM s GROUP BY conv_id""")
def chars_per_page(spark, sf_dir):
    m = F.struct(F.lit("text").alias("format"), F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("int").alias("ocr_page_count"))
    texts = _transcript(spark, sf_dir).withColumn("metadata", m).withColumn("warnings", F.array().cast("array<struct<code:string>>"))
    found = plans.metrics(plans.metadata(texts))
    return found.select("document_id", "chars", "pages", F.round("chars_per_page", 6).alias("chars_per_page"))


@query("SELECT 'media_type_mismatch' AS code, count(*) AS n FROM documents WHERE NOT (starts_with(text, 'BM') OR starts_with(text, '%PDF-') OR starts_with(text, 'GIF8')) AND doc_id % 2 = 0 HAVING count(*) > 0")
def warnings_histogram(spark, sf_dir):
    raw = files.text_documents(spark, f"{sf_dir}/documents.parquet", "doc_id", "text", "txt")
    declared = F.when(F.col("document_id").cast("long") % 2 == 0, "application/pdf").otherwise("text/plain")
    return plans.warnings_histogram(parse(raw.withColumn("declared_media_type", declared)).where("failure IS NULL"))
