"""Queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from corpuslab.llm import conversation_trie, ctw, decontam, embed_dedup, html_extraction, langid, minhash, mixing, pii, quality, substring_dedup, suffix_dedup, whitening

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_substring_dedup": substring_dedup.query,
    "op2_pii": pii.query,
    "op3_decontamination": decontam.query,
    "op4_language_id": langid.query,
    "op5_quality": quality.query,
    "op6_context_tree_lm": ctw.query,
    "op7_embedding_dedup": embed_dedup.query,
    "op8_mixing": mixing.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_minhash_dedup": minhash.query,
    "op11_conversation_trie": conversation_trie.query,
    "op12_embedding_whitening": whitening.query,
    "op13_html_extraction": html_extraction.query,
}
ORACLE: dict[str, str] = {"op8_mixing": mixing.ORACLE}
