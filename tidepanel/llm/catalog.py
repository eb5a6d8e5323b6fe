"""Named queries of this subpackage and their SQL."""

from __future__ import annotations

from tidepanel.llm import bpe, chat, chunk_dedup, context_tree, fingerprint, lexical, mixing, ngram_join, prefix_trie, quality, token_file, url_filter, vectors


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_context_tree": context_tree.op3_context_tree,
        "op4_quality": quality.op4_quality,
        "op5_url_filters": url_filter.op5_url_filters,
        "op6_token_file": token_file.op6_token_file,
        "op7_chat_format": chat.op7_chat_format,
        "op8_near_vectors": vectors.op8_near_vectors,
        "op9_bpe": bpe.op9_bpe,
        "op10_fingerprints": fingerprint.op10_fingerprints,
        "op11_chunk_dedup": chunk_dedup.op11_chunk_dedup,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_lexical_search": lexical.op13_lexical_search,
    }


def oracle_sql() -> dict:
    return {
        "op1_ngram_join": ngram_join.OP1_SQL,
        "op2_mix_sources": mixing.OP2_SQL,
        "op5_url_filters": url_filter.OP5_SQL,
        "op7_chat_format": chat.OP7_SQL,
        "op11_chunk_dedup": chunk_dedup.OP11_SQL,
        "op12_prefix_trie": prefix_trie.OP12_SQL,
        "op13_lexical_search": lexical.OP13_SQL,
    }
