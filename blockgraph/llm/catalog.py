"""The queries of this package by name, with their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, fill_in_middle, filter_audit, language_id, lm_scoring, mixing, near_dedup, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, token_output


def queries():
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_suffix_dedup": suffix_dedup.query,
        "op2_substring_dedup": substring_dedup.query,
        "op3_decontamination": decontamination.query,
        "op4_sharding": sharding.query,
        "op5_lm_scoring": lm_scoring.query,
        "op6_near_dedup": near_dedup.query,
        "op7_token_output": token_output.query,
        "op8_mixing": mixing.query,
        "op9_quality_rules": quality_rules.query,
        "op10_quality_classifier": quality_classifier.query,
        "op11_language_id": language_id.query,
        "op12_fill_in_middle": fill_in_middle.query,
        "op13_filter_audit": filter_audit.query,
    }


def oracle_sql():
    return {"op4_sharding": sharding.SQL, "op6_near_dedup": near_dedup.SQL, "op8_mixing": mixing.SQL, "op9_quality_rules": quality_rules.SQL, "op12_fill_in_middle": fill_in_middle.SQL, "op13_filter_audit": filter_audit.SQL}
