"""Registered queries of the subpackage and their DuckDB statements."""

from __future__ import annotations

from corvane.llm import sql
from corvane.llm.decontam import op10_decontamination
from corvane.llm.html import op1_html_extraction
from corvane.llm.langid import op7_language_id
from corvane.llm.linededup import op9_line_dedup
from corvane.llm.ngram_join import op2_ngram_jaccard_join
from corvane.llm.pieces import op6_sentencepiece
from corvane.llm.quality import op4_quality_classifier
from corvane.llm.rules import op8_quality_rules
from corvane.llm.sharding import op5_sharding
from corvane.llm.toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_ngram_jaccard_join, op3_toxicity, op4_quality_classifier, op5_sharding,
        op6_sentencepiece, op7_language_id, op8_quality_rules, op9_line_dedup, op10_decontamination,
    )
}

ORACLES = {"op8_quality_rules": sql.OP8, "op10_decontamination": sql.OP10}
