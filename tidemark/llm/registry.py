"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm import chat_preference, decontaminate, fm_quality, html_density, jaccard_join, license_scan, line_dedup, near_dedup, packing, quality_rules, resampling, spelling, substring_dedup

QUERIES = {
    "op1_chat_preference": chat_preference.query,
    "op2_license_scan": license_scan.query,
    "op3_line_dedup": line_dedup.query,
    "op4_best_fit_packing": packing.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_quality_classifier": fm_quality.query,
    "op7_html_extraction": html_density.query,
    "op8_minhash_near_dedup": near_dedup.query,
    "op9_quality_rules": quality_rules.query,
    "op10_benchmark_decontamination": decontaminate.query,
    "op11_importance_resampling": resampling.query,
    "op12_spelling_variants": spelling.query,
    "op13_jaccard_join": jaccard_join.query,
}
ORACLES = {
    "op1_chat_preference": chat_preference.SQL,
    "op2_license_scan": license_scan.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op10_benchmark_decontamination": decontaminate.SQL,
    "op11_importance_resampling": resampling.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_jaccard_join": jaccard_join.SQL,
}
