"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from objwatch.llm import audit, decompose, exact_dedup, extraction, jaccard, language, mixing, packing, pii, quality, repair, substring, transport

QUERIES = {
    "op1_language": language.op1_language,
    "op2_mixing": mixing.op2_mixing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality": quality.op4_quality,
    "op5_pii": pii.op5_pii,
    "op6_media": transport.op6_media,
    "op7_substring": substring.op7_substring,
    "op8_packing": packing.op8_packing,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_extraction": extraction.op10_extraction,
    "op11_repair": repair.op11_repair,
    "op12_decomposition": decompose.op12_decomposition,
    "op13_filter_audit": audit.op13_filter_audit,
}
ORACLE_SQL = {
    "op2_mixing": mixing.ORACLE_SQL,
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_jaccard": jaccard.ORACLE_SQL,
    "op13_filter_audit": audit.ORACLE_SQL,
}
