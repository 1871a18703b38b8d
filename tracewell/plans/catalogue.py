"""Registered queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from tracewell.plans import q_bytes, q_canonical, q_documents, q_evidence, q_graph, q_model, q_sharing, q_source, q_sql, q_symbols, q_text, q_validation

FLAGSHIP = "lexical_search"
_PARTS = (q_text, q_graph, q_sql, q_source, q_model, q_evidence, q_canonical, q_documents, q_symbols, q_validation, q_sharing, q_bytes)


def queries() -> dict:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
