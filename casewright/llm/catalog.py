"""Registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from casewright.llm import attention_lm, budget_mix, chat_masks, feistel_pii, golay_dedup, gru_language, histogram_topk, level_products, license_compression, positional_index, repair_tokens, secret_ledger, table_kmeans

QUERIES = {
    "op10_feistel_pii": feistel_pii.op10_feistel_pii,
    "op1_license_compression": license_compression.op1_license_compression,
    "op4_attention_lm": attention_lm.op4_attention_lm,
    "op3_gru_language": gru_language.op3_gru_language,
    "op9_repair_tokens": repair_tokens.op9_repair_tokens,
    "op2_budget_mix": budget_mix.op2_budget_mix,
    "op7_histogram_topk": histogram_topk.op7_histogram_topk,
    "op5_golay_dedup": golay_dedup.op5_golay_dedup,
    "op6_positional_index": positional_index.op6_positional_index,
    "op8_secret_ledger": secret_ledger.op8_secret_ledger,
    "op11_level_products": level_products.op11_level_products,
    "op12_chat_masks": chat_masks.op12_chat_masks,
    "op13_table_kmeans": table_kmeans.op13_table_kmeans,
}

ORACLES = {
    "op7_histogram_topk": histogram_topk.ORACLE_SQL,
    "op6_positional_index": positional_index.ORACLE_SQL,
    "op8_secret_ledger": secret_ledger.ORACLE_SQL,
    "op11_level_products": level_products.ORACLE_SQL,
    "op12_chat_masks": chat_masks.ORACLE_SQL,
    "op13_table_kmeans": table_kmeans.ORACLE_SQL,
}
