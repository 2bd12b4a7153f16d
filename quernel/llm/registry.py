"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import bpe, decontamination, language_id, line_dedup, near_duplicates, quality_classifier, quality_rules, suffix_dedup, toxicity, url_filters

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_bpe": bpe.op4_bpe,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_near_duplicates": near_duplicates.op9_near_duplicates,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES = {"op2_decontamination": decontamination.SQL, "op3_quality_rules": quality_rules.SQL, "op7_line_dedup": line_dedup.SQL}
