"""Queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from parity.llm import byte_bpe, chat_format, exact_dedup, html_extract, language_id, line_dedup, packing, secret_scan, simhash, topk_search

MODULES = (exact_dedup, line_dedup, secret_scan, html_extract, packing, topk_search, chat_format, byte_bpe, simhash, language_id)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
