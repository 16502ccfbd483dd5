"""The registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriesmill.llm.op1_pii import op1_pii
from seriesmill.llm.op10_ngram_jaccard import op10_ngram_jaccard
from seriesmill.llm.op11_whitening import op11_whitening
from seriesmill.llm.op12_periodic_runs import op12_periodic_runs
from seriesmill.llm.op13_chat_template import op13_chat_template
from seriesmill.llm.op2_substring_dedup import op2_substring_dedup
from seriesmill.llm.op3_lm_scoring import op3_lm_scoring
from seriesmill.llm.op4_decontaminate import op4_decontaminate
from seriesmill.llm.op5_html_text import op5_html_text
from seriesmill.llm.op6_mix_sources import ORACLE_SQL as OP6_SQL
from seriesmill.llm.op6_mix_sources import op6_mix_sources
from seriesmill.llm.op7_quality_classifier import op7_quality_classifier
from seriesmill.llm.op8_quality_rules import op8_quality_rules
from seriesmill.llm.op9_warc import ORACLE_SQL as OP9_SQL
from seriesmill.llm.op9_warc import op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_decontaminate": op4_decontaminate,
    "op5_html_text": op5_html_text,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_warc": op9_warc,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_whitening": op11_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_chat_template": op13_chat_template,
}
ORACLES: dict[str, str] = {
    "op6_mix_sources": OP6_SQL,
    "op9_warc": OP9_SQL,
}
