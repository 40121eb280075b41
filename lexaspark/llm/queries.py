"""The registered queries over the training-data operators, and their SQL."""

from __future__ import annotations

from lexaspark.llm import decontamination, html_extraction, jaccard_join, language_id, licenses, lm_scoring, mixing, nearest, sharding, token_output

QUERIES = {
    "op1_nearest_neighbours": nearest.op1_nearest_neighbours,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_language_id": language_id.op3_language_id,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_sharding": sharding.op5_sharding,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_html_extraction": html_extraction.op7_html_extraction,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_token_output": token_output.op9_token_output,
    "op10_decontamination": decontamination.op10_decontamination,
}
ORACLE_SQL = {
    "op1_nearest_neighbours": nearest.SQL,
    "op8_license_scan": licenses.SQL,
    "op10_decontamination": decontamination.SQL,
}
