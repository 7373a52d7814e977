"""The subpackage's registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import exact_dedup, html_extract, language_id, mixing, ngram_join, packing, sharding, suffix_dedup, topk_search, toxicity

QUERIES = {
    "op4_html_extraction": html_extract.op4_html_extraction,
    "op1_mixing": mixing.op1_mixing,
    "op8_sharding": sharding.op8_sharding,
    "op3_exact_topk": topk_search.op3_exact_topk,
    "op7_toxicity": toxicity.op7_toxicity,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op5_ngram_jaccard_join": ngram_join.op5_ngram_jaccard_join,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_language_id": language_id.op10_language_id,
}

SQL = {"op3_exact_topk": topk_search.SQL, "op6_exact_dedup": exact_dedup.SQL}
