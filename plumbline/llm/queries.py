"""The queries of this subpackage and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from plumbline.llm.alignment import op13_tokenizer_alignment
from plumbline.llm.bpe import op6_bpe
from plumbline.llm.chat import OP2_SQL, op2_chat_formatting
from plumbline.llm.goodness import op11_quality_classifier
from plumbline.llm.jaccard import OP10_SQL, op10_jaccard_join
from plumbline.llm.licences import op9_license_scan
from plumbline.llm.lm import op1_lm_scoring
from plumbline.llm.packing import op5_packing
from plumbline.llm.quality import OP7_SQL, op7_quality_rules
from plumbline.llm.shards import op8_sharding
from plumbline.llm.spelling import OP12_SQL, op12_spelling_variants
from plumbline.llm.toxicity import op3_toxicity
from plumbline.llm.vectors import OP4_SQL, op4_vector_duplicates


def queries() -> dict:
    return {"op1_lm_scoring": op1_lm_scoring, "op2_chat_formatting": op2_chat_formatting, "op3_toxicity": op3_toxicity, "op4_vector_duplicates": op4_vector_duplicates, "op5_packing": op5_packing, "op6_bpe": op6_bpe, "op7_quality_rules": op7_quality_rules, "op8_sharding": op8_sharding, "op9_license_scan": op9_license_scan, "op10_jaccard_join": op10_jaccard_join, "op11_quality_classifier": op11_quality_classifier, "op12_spelling_variants": op12_spelling_variants, "op13_tokenizer_alignment": op13_tokenizer_alignment}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": OP2_SQL, "op4_vector_duplicates": OP4_SQL, "op7_quality_rules": OP7_SQL, "op10_jaccard_join": OP10_SQL, "op12_spelling_variants": OP12_SQL}
