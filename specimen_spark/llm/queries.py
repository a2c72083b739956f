"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import conversations, exact_dedup, fingerprints, lexical, lm_scoring, mixing, near_dedup, packing, quality, repeats, substrings, toxicity, wrappers

QUERIES = {
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op1_html_extraction": wrappers.op1_html_extraction,
    "op6_packing": packing.op6_packing,
    "op7_quality": quality.op7_quality,
    "op8_repeats": repeats.op8_repeats,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_substrings": substrings.op11_substrings,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_lexical_search": lexical.op13_lexical_search,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op3_mixing": mixing.SQL,
    "op5_fingerprints": fingerprints.SQL,
    "op13_lexical_search": lexical.SQL,
}
