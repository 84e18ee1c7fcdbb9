"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import oracles
from millrace.llm.chat_format import op8_chat_format
from millrace.llm.decontaminate import op7_decontaminate
from millrace.llm.divergence import op12_source_divergence
from millrace.llm.html_extract import op3_html_extract
from millrace.llm.jaccard_join import op5_ngram_jaccard
from millrace.llm.katz import op9_katz_score
from millrace.llm.mixing import op6_mixing
from millrace.llm.quality_classifier import op10_quality_classifier
from millrace.llm.quality_rules import op4_quality_rules
from millrace.llm.secrets import op2_secret_scan
from millrace.llm.token_alignment import op11_token_alignment
from millrace.llm.url_filter import op1_url_filter
from millrace.llm.window_packing import op13_ss_packing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_secret_scan": op2_secret_scan,
    "op3_html_extract": op3_html_extract,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_chat_format": op8_chat_format,
    "op9_katz_score": op9_katz_score,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_token_alignment": op11_token_alignment,
    "op12_source_divergence": op12_source_divergence,
    "op13_ss_packing": op13_ss_packing,
    **oracles.QUERIES,
}

#: Trees, automata, estimates, draws and models cannot be put into SQL; the parts that
#: can have queries of their own.
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
