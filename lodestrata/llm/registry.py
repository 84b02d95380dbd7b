"""The queries of this package and the SQL that checks them."""

from __future__ import annotations

from . import byte_bpe, conversation_trie, embedding_dedup, line_dedup, merkle_manifest, mixing, quality_crf, secret_scan, simhash_dedup, token_counts, tool_links, topk_search, url_filter

MODULES = [tool_links, line_dedup, merkle_manifest, mixing, quality_crf, topk_search, token_counts, byte_bpe, url_filter, simhash_dedup, embedding_dedup, secret_scan, conversation_trie, merkle_manifest]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
