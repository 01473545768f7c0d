"""Queries and SQL of this package, for the entry module."""

from __future__ import annotations

from . import chat, decontaminate, jaccard, packing, pages, pii, quality, repeats, token_counts, vectors

MODULES = [chat, jaccard, repeats, packing, quality, pii, token_counts, vectors, decontaminate, pages]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
