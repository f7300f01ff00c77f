"""Queries of this package for the driver, and SQL where it can express them."""

from __future__ import annotations

from . import chat_format, decontamination, exact_dedup, filter_audit, jaccard_join, language_id, license_scan
from . import mixing, secret_scan, sharding, sort_means, substring_dedup, token_count

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_sharding": sharding.op2_sharding,
    "op10_license_scan": license_scan.op10_license_scan,
    "op3_mixing": mixing.op3_mixing,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_language_id": language_id.op5_language_id,
    "op6_token_count": token_count.op6_token_count,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op11_sort_means": sort_means.op11_sort_means,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_chat_format": chat_format.op13_chat_format,
}
ORACLES = {
    "op1_secret_scan": secret_scan.SQL,
    "op2_sharding": sharding.SQL,
    "op3_mixing": mixing.SQL,
    "op4_jaccard_join": jaccard_join.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
    "op11_sort_means": sort_means.SQL,
    "op12_filter_audit": filter_audit.SQL,
    "op13_chat_format": chat_format.SQL,
}
