"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from loomspan.llm.centroids import op12_centroids, op12_sql
from loomspan.llm.decontaminate import OP5_SQL, op5_decontamination
from loomspan.llm.html_text import op1_html_extraction
from loomspan.llm.language_id import op6_language_id
from loomspan.llm.line_dedup import OP4_SQL, op4_line_dedup
from loomspan.llm.near_dedup import OP3_SQL, op3_near_dedup
from loomspan.llm.packing import op8_packing
from loomspan.llm.pieces import op13_pieces
from loomspan.llm.quality_classifier import op9_quality_classifier
from loomspan.llm.quality_rules import op2_quality_rules, op2_sql
from loomspan.llm.schema_rewrite import op11_schema_rewrite
from loomspan.llm.suffix_dedup import OP7_SQL, op7_suffix_dedup
from loomspan.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_rules": op2_quality_rules,
    "op3_near_dedup": op3_near_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_packing": op8_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_toxicity": op10_toxicity,
    "op11_schema_rewrite": op11_schema_rewrite,
    "op12_centroids": op12_centroids,
    "op13_pieces": op13_pieces,
}

SQL = {
    "op2_quality_rules": op2_sql(),
    "op3_near_dedup": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op5_decontamination": OP5_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op12_centroids": op12_sql(),
}
