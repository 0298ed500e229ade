"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from sporeline.llm import bpe, conversation_repair, decontam, near_dedup, pii, quality, resampling, secrets, shards, substring_dedup, suffix_dedup, token_counts, token_files

QUERIES = {
    "op1_interleaved_shards": shards.op1_interleaved_shards,
    "op2_sparse_suffix_dedup": suffix_dedup.op2_sparse_suffix_dedup,
    "op3_bpe_tree": bpe.op3_bpe_tree,
    "op4_bootstrapped_pii": pii.op4_bootstrapped_pii,
    "op5_secret_ledger": secrets.op5_secret_ledger,
    "op6_cgk_decontamination": decontam.op6_cgk_decontamination,
    "op7_token_rollups": token_counts.op7_token_rollups,
    "op8_paragraph_minhash": substring_dedup.op8_paragraph_minhash,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_token_files": token_files.op11_token_files,
    "op12_target_resampling": resampling.op12_target_resampling,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

SQL = {
    "op1_interleaved_shards": shards.OP1_SQL,
    "op5_secret_ledger": secrets.OP5_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "op12_target_resampling": resampling.OP12_SQL,
    "op13_conversation_repair": conversation_repair.OP13_SQL,
}
