"""The queries opN_<name> and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from . import chunks, decontam, lexicon, licences, mixing, neardup, phrases, prefixtrie, quality, sharding, tokenfile, topk, toxicity


def queries() -> dict:
    return {
        "op1_mix_to_weights": mixing.op1_mix_to_weights,
        "op2_ftrl_toxicity": toxicity.op2_ftrl_toxicity,
        "op3_licence_scan": licences.op3_licence_scan,
        "op4_attention_mil_quality": quality.op4_attention_mil_quality,
        "op5_segment_top_k": topk.op5_segment_top_k,
        "op6_simple8b_token_files": tokenfile.op6_simple8b_token_files,
        "op7_minhash_near_dedup": neardup.op7_minhash_near_dedup,
        "op8_chunk_substring_dedup": chunks.op8_chunk_substring_dedup,
        "op9_template_decontamination": decontam.op9_template_decontamination,
        "op10_jump_hash_sharding": sharding.op10_jump_hash_sharding,
        "op11_transducer_bpe": lexicon.op11_transducer_bpe,
        "op12_setm_phrases": phrases.op12_setm_phrases,
        "op13_conversation_prefix_trie": prefixtrie.op13_conversation_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_segment_top_k": topk.ORACLE_SQL,
        "op7_minhash_near_dedup": neardup.ORACLE_SQL,
        "op9_template_decontamination": decontam.ORACLE_SQL,
        "op10_jump_hash_sharding": sharding.ORACLE_SQL,
        "op12_setm_phrases": phrases.ORACLE_SQL,
        "op13_conversation_prefix_trie": prefixtrie.ORACLE_SQL,
    }
