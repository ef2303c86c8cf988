"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, compact, counts, decontaminate, lm, packing, quality, simhash, sstable, suffix_dedup, toxicity, variants, whitening

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_suffix_array_dedup": suffix_dedup.query,
    "op3_chat_formatting": chat.query,
    "op4_simhash_near_dedup": simhash.query,
    "op5_benchmark_decontamination": decontaminate.query,
    "op6_best_fit_packing": packing.query,
    "op7_sstable_output": sstable.query,
    "op8_compact_windows": compact.query,
    "op9_quality_rules": quality.query,
    "op10_lm_scoring": lm.query,
    "op11_token_counts": counts.query,
    "op12_embedding_whitening": whitening.query,
    "op13_spelling_variants": variants.query,
}

ORACLE: dict[str, str] = {
    "op2_suffix_array_dedup": suffix_dedup.SQL,
    "op3_chat_formatting": chat.SQL,
    "op5_benchmark_decontamination": decontaminate.SQL,
    "op9_quality_rules": quality.SQL,
    "op13_spelling_variants": variants.SQL,
}
