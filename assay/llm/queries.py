"""The registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from assay.llm import chat, covertree, exact_dedup, html, langid, mixing, pieces, quality, simhash, toxicity

QUERIES = {
    "op1_embedding_near_dedup": covertree.op1_query,
    "op2_language_id": langid.op2_query,
    "op3_quality_classifier": quality.op3_query,
    "op4_html_extraction": html.op4_query,
    "op5_toxicity": toxicity.op5_query,
    "op6_exact_dedup": exact_dedup.op6_query,
    "op7_sentencepiece": pieces.op7_query,
    "op8_chat_formatting": chat.op8_query,
    "op9_source_mixing": mixing.op9_query,
    "op10_simhash_near_dedup": simhash.op10_query,
}

ORACLE_SQL = {
    "op1_embedding_near_dedup": covertree.OP1_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op8_chat_formatting": chat.OP8_SQL,
    "op9_source_mixing": mixing.OP9_SQL,
}
