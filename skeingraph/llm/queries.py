"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from skeingraph.llm import chat, imatch, jaccard, packing, pieces, pii, suffixtree, topk, toxicity, urls

QUERIES = {
    "op1_chat_formatting": chat.query,
    "op2_url_filters": urls.query,
    "op3_lm_scoring": suffixtree.query,
    "op4_ngram_jaccard_join": jaccard.query,
    "op5_toxicity": toxicity.query,
    "op6_sentencepiece": pieces.query,
    "op7_exact_top_k": topk.query,
    "op8_pii": pii.query,
    "op9_document_fingerprints": imatch.query,
    "op10_best_fit_packing": packing.query,
}
SQL = {"op1_chat_formatting": chat.SQL, "op2_url_filters": urls.SQL, "op4_ngram_jaccard_join": jaccard.SQL, "op7_exact_top_k": topk.SQL}
