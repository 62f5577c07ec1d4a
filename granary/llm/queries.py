"""The queries that apply each operator to its whole table, and their SQL where SQL can express them."""
from __future__ import annotations

from granary.llm import exact_dedup, license_scan, mixing, near_dedup, packing, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op5_license_scan": license_scan.op5_license_scan,
    "op2_packing": packing.op2_packing,
    "op3_mixing": mixing.op3_mixing,
    "op4_token_counts": token_counts.op4_token_counts,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
}
ORACLE_SQL = {"op6_exact_dedup": exact_dedup.OP6_SQL}
