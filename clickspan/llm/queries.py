"""Registered queries of the operators for training text, with their DuckDB SQL where SQL can express them."""

from clickspan.llm import (
    chat, clusters, decontaminate, html, language, manifest, mixing, neardup, neighbours, packing, pii, quality, substring,
)

QUERIES = {f.__name__: f for f in [
    language.op1_family_svm,
    quality.op2_quality_rules,
    html.op3_min_cut,
    packing.op4_best_fit_packing,
    substring.op5_substring_dedup,
    pii.op6_context_pii,
    neighbours.op7_multi_index,
    chat.op8_chat_format,
    neardup.op9_hyperminhash,
    mixing.op10_mix_sources,
    decontaminate.op11_winnowing,
    manifest.op12_bitmap_rank,
    clusters.op13_incremental_centroids,
]}

ORACLES = {
    "op2_quality_rules": quality.OP2_SQL,
    "op5_substring_dedup": substring.OP5_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op9_hyperminhash": neardup.OP9_SQL,
    "op10_mix_sources": mixing.OP10_SQL,
    "op11_winnowing": decontaminate.OP11_SQL,
    "op12_bitmap_rank": manifest.OP12_SQL,
    "op13_incremental_centroids": clusters.OP13_SQL,
}
