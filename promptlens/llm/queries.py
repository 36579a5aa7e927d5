"""Registered queries of this subpackage and the SQL that states the same."""

from __future__ import annotations

from promptlens.llm import binpack, bitpack, chat, decontaminate, htmltext, jaccard, langid, lm, merkle, pii, topk, toxicity, whiten

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_html_text": htmltext.op2_html_text,
    "op3_token_ids": bitpack.op3_token_ids,
    "op4_lm_score": lm.op4_lm_score,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_best_fit": binpack.op6_best_fit,
    "op7_pii": pii.op7_pii,
    "op8_winnowing": decontaminate.op8_winnowing,
    "op9_top_k": topk.op9_top_k,
    "op10_jaccard": jaccard.op10_jaccard,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_chat_format": chat.op12_chat_format,
    "op13_whiten": whiten.op13_whiten,
}
ORACLE = {
    "op10_jaccard": jaccard.OP10_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op12_chat_format": chat.OP12_SQL,
    "op8_winnowing": decontaminate.OP8_SQL,
    "op9_top_k": topk.OP9_SQL,
}
