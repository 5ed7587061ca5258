"""Quotes in documents: exact after folding, else aligned to the block that shares most words.

Exact search is column expressions over one equi-join by document.  Only the misses reach the candidate join (distinct
tokens of quote and block), and only its best blocks the alignment, which runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quillmark.functions import plain
from quillmark.functions.text import fold, occurrences, strip, tokens
from quillmark.operators.lookup import block_at, page_at
from quillmark.plans.store import kept

#: Shortest quote, similarity that a near miss needs, candidates that are aligned.
MIN_CHARS, SNAP, CANDIDATES = 8, 0.90, 40
#: Quotes that are broadcast in a search of all texts; more of them meet the texts by shuffle.
FEW_QUOTES = 20_000
ABSENT = "does not appear in the document, exactly or approximately"


def gate(quotes: DataFrame) -> DataFrame:
    """Adds needle (the folded quote) and reason (why it can't be looked up, or null)."""
    cleaned = strip(F.col("quote"))
    short = F.concat(F.lit("too short to be a citation ("), F.length(cleaned).cast("string"), F.lit(f" chars); quote at least {MIN_CHARS}"))
    df = quotes.withColumn("needle", strip(fold(cleaned)))
    return df.withColumn("reason", F.when(F.length(cleaned) < MIN_CHARS, short).when(F.col("needle") == "", "empty quote"))


def folded(texts: DataFrame) -> DataFrame:
    return texts.withColumn("folded", fold(F.col("text")))


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
def _origins(text: pd.Series, at: pd.Series, size: pd.Series) -> pd.DataFrame:
    """Span in the text of a span of its fold."""
    rows = []
    for t, a, n in zip(text, at, size, strict=True):
        if t is None or pd.isna(a) or a < 0:
            rows.append((None, None))
            continue
        origin = plain.fold(t)[1]
        a, n = int(a), int(n)
        rows.append((origin[a], min(origin[a + n - 1] + 1, len(t)) if n else origin[a]))
    return pd.DataFrame(rows, columns=["start", "end"]).astype("Int32")


def exact(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Quotes (document_id, quote_idx, needle) that stand in their document: first place and overlapping count.

    Result: document_id, quote_idx, span_start, span_end, occurrences.
    """
    met = quotes.join(texts.select("document_id", "text", "folded"), "document_id").withColumn("at", F.expr("locate(needle, folded)") - 1).where("at >= 0")
    counted = met.withColumn("occurrences", occurrences(F.col("folded"), F.col("needle"))).withColumn("span", _origins("text", "at", F.length("needle")))
    return counted.select("document_id", "quote_idx", F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"), "occurrences")


def candidates(quotes: DataFrame, blocks: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """The blocks that share most distinct tokens with each quote: document_id, quote_idx, ordinal, shared.

    A quote without a token gets the first blocks of its document.  Ties go to the earlier block.
    blocks: document_id, ordinal, hay (folded own text).
    """
    of_quote = quotes.select("document_id", "quote_idx", F.explode(tokens(F.col("needle"))).alias("token"))
    of_block = blocks.select("document_id", "ordinal", F.explode(tokens(F.col("hay"))).alias("token"))
    shared = of_quote.join(of_block, ["document_id", "token"]).groupBy("document_id", "quote_idx", "ordinal").agg(F.count(F.lit(1)).alias("shared"))
    bare = quotes.where(F.size(tokens(F.col("needle"))) == 0).select("document_id", "quote_idx")
    first = bare.join(blocks.where(F.col("ordinal") < limit).select("document_id", "ordinal"), "document_id").withColumn("shared", F.lit(0).cast("long"))
    best = Window.partitionBy("document_id", "quote_idx").orderBy(F.desc("shared"), "ordinal")
    return shared.unionByName(first).withColumn("n", F.row_number().over(best)).where(F.col("n") <= limit).drop("n")


def align(needle: str, hay: str) -> tuple[float, int, int] | None:
    """Similarity and region of the best alignment of a quote within a block, widened to whole words."""
    if not hay.strip() or len(hay) < 0.5 * len(needle):
        return None
    runs = [m for m in SequenceMatcher(None, needle, hay, autojunk=False).get_matching_blocks() if m.size]
    if not runs:
        return None
    low, high = runs[0].b, runs[-1].b + runs[-1].size
    while low and hay[low - 1].isalnum():
        low -= 1
    while high < len(hay) and hay[high].isalnum():
        high += 1
    return SequenceMatcher(None, needle, hay[low:high], autojunk=False).ratio(), low, high


def snap(quotes: DataFrame, texts: DataFrame, own: DataFrame) -> DataFrame:
    """Near misses: document_id, quote_idx, span_start, span_end, similarity, of the most similar candidate.

    own: document_id, ordinal, span_start, own_end (a block without its children).  The earlier block wins a tie.
    """
    bodies = own.join(texts.select("document_id", "text"), "document_id")
    hay = bodies.select("document_id", "ordinal", F.col("span_start").alias("block_start"), F.expr("substring(text, span_start + 1, own_end - span_start)").alias("own_text"))
    hay = hay.withColumn("hay", fold(F.col("own_text")))
    chosen = candidates(quotes, hay).join(hay, ["document_id", "ordinal"]).join(quotes.select("document_id", "quote_idx", "needle"), ["document_id", "quote_idx"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, q, o, start, text, needle in zip(f["document_id"], f["quote_idx"], f["ordinal"], f["block_start"], f["own_text"], f["needle"], strict=True):
                hay, origin = plain.fold(text)
                found = align(needle, hay)
                if found and found[0] >= SNAP:
                    ratio, low, high = found
                    rows.append((d, q, o, ratio, int(start) + origin[low], int(start) + origin[high - 1] + 1))
            yield pd.DataFrame(rows, columns=["document_id", "quote_idx", "ordinal", "similarity", "span_start", "span_end"])

    kinds = dict(quotes.dtypes)
    # alignment costs far more than its bytes tell, so the pairs are dealt out and not coalesced
    dealt = chosen.repartition(int(quotes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "document_id", "quote_idx", "ordinal")
    scored = dealt.mapInPandas(run, f"document_id {kinds['document_id']}, quote_idx {kinds['quote_idx']}, ordinal int, similarity double, span_start int, span_end int")
    best = F.max_by(F.struct("span_start", "span_end", "similarity"), F.struct("similarity", (-F.col("ordinal")).alias("early"))).alias("best")
    return scored.groupBy("document_id", "quote_idx").agg(best).select("document_id", "quote_idx", "best.*")


def locate(quotes: DataFrame, texts: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Every quote with its match ('exact', 'snapped' or 'none'), span, source text, page, block and confidence.

    quotes: document_id, quote_idx, quote; texts: document_id, text; blocks: of ``block_table``; pages: of
    ``page_table``; all are read several times, so they should be stored tables.  A quote of an unknown document is not
    found.
    """
    asked = gate(quotes)
    open_ = asked.where("reason IS NULL")
    ready = folded(texts)
    hits = kept(exact(open_, ready), "exact-quotes").withColumn("match", F.lit("exact")).withColumn("similarity", F.lit(1.0))
    missed = open_.join(hits.select("document_id", "quote_idx"), ["document_id", "quote_idx"], "left_anti")
    near = kept(snap(missed, texts, blocks), "near-quotes").withColumn("match", F.lit("snapped")).withColumn("occurrences", F.lit(1).cast("long"))
    found = hits.unionByName(near)
    at = found.select("document_id", "quote_idx", F.col("span_start").alias("offset"))
    placed = block_at(at, blocks).join(page_at(at, pages), ["document_id", "quote_idx", "offset"]).drop("offset")
    block_info = blocks.select("document_id", F.col("ordinal").alias("block_ordinal"), F.col("id").alias("block_id"), F.col("confidence").alias("block_confidence"))
    page_info = pages.select("document_id", F.col("number").alias("page"), "source", F.col("confidence").alias("page_confidence"))
    full = found.join(placed, ["document_id", "quote_idx"]).join(block_info, ["document_id", "block_ordinal"], "left").join(page_info, ["document_id", "page"], "left").join(texts.select("document_id", F.col("text").alias("whole")), "document_id")
    decorated = full.select(
        "document_id", "quote_idx", "match", "span_start", "span_end", F.expr("substring(whole, span_start + 1, span_end - span_start)").alias("text"), "page", "block_id", "occurrences",
        F.round("similarity", 4).alias("similarity"), F.coalesce(F.col("source") == "ocr", F.lit(False)).alias("ocr_applied"),
        # a confidence of zero says as little as none
        F.coalesce(F.expr("nullif(block_confidence, 0D)"), F.col("page_confidence")).alias("confidence"),
    )
    out = asked.select("document_id", "quote_idx", "quote", "reason").join(decorated, ["document_id", "quote_idx"], "left")
    return out.select(
        "document_id", "quote_idx", "quote", F.col("match").isNotNull().alias("found"), F.coalesce("match", F.lit("none")).alias("match"), "span_start", "span_end", "text", "page", "block_id",
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("ocr_applied", F.lit(False)).alias("ocr_applied"), "confidence",
        F.when(F.col("match").isNull(), F.coalesce("reason", F.lit(ABSENT))).alias("reason"),
    )


def locate_corpus(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Every quote in every text: quote_id, document_id, position (in the folded text, from 0) and occurrences.

    A text that holds a quote holds all words of it but the first and the last whole, so the longest of those is the
    key of an equi-join that leaves few pairs to search.  Quotes of at most two words meet on their first characters.
    quotes: quote_id, quote; texts: document_id, text.
    """
    asked = gate(quotes).where("reason IS NULL").withColumn("inner", F.split("needle", " "))
    asked = asked.withColumn("inner", F.when(F.size("inner") > 2, F.slice("inner", F.lit(2), F.size("inner") - 2)))
    longest = F.array_max(F.transform("inner", lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    asked = asked.select("quote_id", "needle", longest.alias("word"))
    ready = folded(texts).select("document_id", "folded")
    by_word = asked.where("word IS NOT NULL")
    each = F.explode(F.array_distinct(F.split("folded", " "))).alias("word")
    if by_word.limit(FEW_QUOTES + 1).count() <= FEW_QUOTES:  # few enough to send to the texts
        met = ready.select("document_id", "folded", each).join(F.broadcast(by_word), "word").select("quote_id", "document_id", "needle", "folded")
    else:  # words and quotes meet without the texts, which are then fetched for the pairs alone
        pairs = ready.select("document_id", each).join(by_word, "word").select("quote_id", "document_id", "needle")
        met = pairs.join(ready, "document_id").select("quote_id", "document_id", "needle", "folded")
    brief = asked.where("word IS NULL")
    if not brief.isEmpty():
        grams = F.expr(f"array_distinct(transform(sequence(1, greatest(length(folded) - {MIN_CHARS - 1}, 1)), i -> substring(folded, i, {MIN_CHARS})))")
        near = ready.select("document_id", "folded", F.explode(grams).alias("gram")).join(brief.withColumn("gram", F.substring("needle", 1, MIN_CHARS)), "gram")
        met = met.unionByName(near.select("quote_id", "document_id", "needle", "folded"))
    found = met.withColumn("position", (F.expr("locate(needle, folded)") - 1).cast("long")).where("position >= 0")
    return found.select("quote_id", "document_id", "position", occurrences(F.col("folded"), F.col("needle")).alias("occurrences"))
