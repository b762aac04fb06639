"""All core queries and their oracles, by name."""

from __future__ import annotations

from termloom.plans import dom_queries, index_queries, linalg_queries, packed_queries, recommend_queries, scalar_queries, vector_queries

_MODULES = [packed_queries, index_queries, vector_queries, recommend_queries, linalg_queries, dom_queries, scalar_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
