"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm.chat import OP8_SQL, op8_chat_format
from quillmark.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from quillmark.llm.html_content import op2_html_content
from quillmark.llm.language import op5_language
from quillmark.llm.nearest import op3_nearest
from quillmark.llm.packing import op6_best_fit_packing
from quillmark.llm.pieces import op1_sentencepiece
from quillmark.llm.quality import op9_quality
from quillmark.llm.simhash import op10_simhash
from quillmark.llm.token_files import op4_token_files


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_html_content": op2_html_content,
        "op3_nearest": op3_nearest,
        "op4_token_files": op4_token_files,
        "op5_language": op5_language,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_chat_format": op8_chat_format,
        "op9_quality": op9_quality,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op8_chat_format": OP8_SQL}
