"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from sellerlens.llm import op01_substring_dedup as op1
from sellerlens.llm import op02_quality_rules as op2
from sellerlens.llm import op03_lm_scoring as op3
from sellerlens.llm import op04_token_output as op4
from sellerlens.llm import op05_token_counts as op5
from sellerlens.llm import op06_ngram_join as op6
from sellerlens.llm import op07_quality_classifier as op7
from sellerlens.llm import op08_html_extraction as op8
from sellerlens.llm import op09_mixing as op9
from sellerlens.llm import op10_decontamination as op10
from sellerlens.llm import op11_secret_scan as op11
from sellerlens.llm import op12_ranked_search as op12
from sellerlens.llm import op13_spelling_variants as op13

QUERIES = {
    "op1_substring_dedup": op1.op1_substring_dedup,
    "op2_quality_rules": op2.op2_quality_rules,
    "op3_lm_scoring": op3.op3_lm_scoring,
    "op4_token_output": op4.op4_token_output,
    "op5_token_counts": op5.op5_token_counts,
    "op6_ngram_join": op6.op6_ngram_join,
    "op7_quality_classifier": op7.op7_quality_classifier,
    "op8_html_extraction": op8.op8_html_extraction,
    "op9_mixing": op9.op9_mixing,
    "op10_decontamination": op10.op10_decontamination,
    "op11_secret_scan": op11.op11_secret_scan,
    "op12_ranked_search": op12.op12_ranked_search,
    "op13_spelling_variants": op13.op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op2_quality_rules": op2.ORACLE_SQL,
    "op9_mixing": op9.ORACLE_SQL,
    "op12_ranked_search": op12.ORACLE_SQL,
}
