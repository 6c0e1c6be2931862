"""Queries of this subpackage: one per operator, and the pipeline."""

from __future__ import annotations

from . import (
    conversation_trie,
    language_id,
    license_scan,
    line_dedup,
    merkle_manifest,
    packing,
    piece_codec,
    quality_classifier,
    quality_rules,
    simhash_dedup,
    suffix_dedup,
    token_counts,
    topk_search,
)


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_quality_classifier": quality_classifier.op1,
        "op2_topk_search": topk_search.op2,
        "op3_line_dedup": line_dedup.op3,
        "op4_license_scan": license_scan.op4,
        "op5_piece_codec": piece_codec.op5,
        "op6_token_counts": token_counts.op6,
        "op7_quality_rules": quality_rules.op7,
        "op8_simhash_near_dedup": simhash_dedup.op8,
        "op9_packing": packing.op9,
        "op10_suffix_dedup": suffix_dedup.op10,
        "op11_conversation_trie": conversation_trie.op11,
        "op12_language_id": language_id.op12,
        "op13_merkle_manifest": merkle_manifest.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {
        "op2_topk_search": topk_search.OP2_SQL,
        "op4_license_scan": license_scan.op4_sql(),
        "op11_conversation_trie": conversation_trie.OP11_SQL,
        "op13_merkle_manifest": merkle_manifest.op13_sql(),
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {k: v for k, v in found.items() if v}
