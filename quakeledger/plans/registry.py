"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from quakeledger.plans import audit_queries, corpus_queries, pipeline_general, study_queries

MODULES = (audit_queries, corpus_queries, study_queries, pipeline_general)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
