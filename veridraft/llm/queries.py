"""Registered queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from veridraft.llm import (
    bpe, chat, exact, negatives, packing, passages, pii, quality, repair, secrets, simhash, topk, urls,
)

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_byte_pairs": bpe.op2_byte_pairs,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_personal_data": pii.op4_personal_data,
    "op5_packing": packing.op5_packing,
    "op6_url_filter": urls.op6_url_filter,
    "op7_chat_format": chat.op7_chat_format,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_passages": passages.op10_passages,
    "op11_top_k_search": topk.op11_top_k_search,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

#: The others hold models, tokenizers or search; tests/llm compares them with plain forms.
SQL = {
    "op7_chat_format": chat.OP7_SQL,
    "op8_exact_dedup": exact.OP8_SQL,
    "op11_top_k_search": topk.OP11_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
    "op13_conversation_repair": repair.OP13_SQL,
}
