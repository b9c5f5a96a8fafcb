"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP6_SQL, op6_chat_format
from .clustering import OP11_SQL, op11_centroid_clustering
from .decontaminate import OP1_SQL, op1_decontaminate
from .html_extract import op12_html_extraction
from .line_dedup import OP2_SQL, op2_line_dedup
from .lm_score import op7_lm_score
from .mixing import op10_mixing
from .ngram_join import OP9_SQL, op9_ngram_join
from .token_output import op3_token_output
from .topk import OP8_SQL, op8_topk
from .toxicity import op5_toxicity
from .url_filter import OP4_SQL, op4_url_filter
from .whitening import op13_whitening

_QUERIES = (
    op1_decontaminate, op2_line_dedup, op3_token_output, op4_url_filter, op5_toxicity, op6_chat_format, op7_lm_score, op8_topk, op9_ngram_join,
    op10_mixing, op11_centroid_clustering, op12_html_extraction, op13_whitening,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """Encoding, learnt scores and random rounding have no SQL; tests hold them against brute force."""
    return {
        "op1_decontaminate": OP1_SQL,
        "op2_line_dedup": OP2_SQL,
        "op4_url_filter": OP4_SQL,
        "op6_chat_format": OP6_SQL,
        "op8_topk": OP8_SQL,
        "op9_ngram_join": OP9_SQL,
        "op11_centroid_clustering": OP11_SQL,
    }
