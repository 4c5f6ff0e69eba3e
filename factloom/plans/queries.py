"""All registered queries of the library."""

from __future__ import annotations

from factloom.plans import q_answers, q_audit, q_client, q_evidence, q_facts, q_index, q_more, q_ordered, q_parts, q_protocols, q_quoted, q_records, q_retrieval, q_stores  # noqa: F401
from factloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
