"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from treesnap.llm import conversation_repair, decontaminate, language, line_dedup, near_dedup, packing, periodic_runs, pii, quality_knn, quality_rules, secret_spans, sharding, token_files

QUERIES = {
    "op1_quality_classifier": quality_knn.op1_quality_classifier,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_language": language.op4_language,
    "op5_packing": packing.op5_packing,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_token_files": token_files.op8_token_files,
    "op9_pii_surrogates": pii.op9_pii_surrogates,
    "op10_sharding": sharding.op10_sharding,
    "op11_secret_spans": secret_spans.op11_secret_spans,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

ORACLE = {
    "op7_decontamination": decontaminate.ORACLE,
    "op10_sharding": sharding.ORACLE,
}
