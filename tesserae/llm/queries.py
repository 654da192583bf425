"""The queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from . import ann, conversations, fingerprints, importance, licenses, lines, mixing, neardup, packing, quality, token_files, toxicity, urls

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_token_files": token_files.op2_token_files,
    "op3_packing": packing.op3_packing,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_url_filter": urls.op5_url_filter,
    "op6_quality": quality.op6_quality,
    "op7_temperature_mixing": mixing.op7_temperature_mixing,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_permutation_index": ann.op10_permutation_index,
    "op11_license_scan": licenses.op11_license_scan,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_importance_resampling": importance.op13_importance_resampling,
}

#: Signatures, classifiers, tokenizers, hundreds of rules and Unicode composition are beyond DuckDB's SQL: brute-force tests instead.
ORACLES: dict[str, str] = {"op12_conversation_repair": conversations.SQL, "op13_importance_resampling": importance.SQL}
