"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import byte_bpe, decontamination, language_id, pii, quality_classifier, quality_rules, sharding, simhash, substring_dedup, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_benchmark_decontamination": decontamination.op2_benchmark_decontamination,
    "op3_language_id": language_id.op3_language_id,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_virtual_slot_sharding": sharding.op7_virtual_slot_sharding,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_feistel_pii": pii.op9_feistel_pii,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op2_benchmark_decontamination": decontamination.ORACLE,
    "op7_virtual_slot_sharding": sharding.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
}
