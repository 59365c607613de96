"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from quakeledger.llm import q_lookalikes, q_matching, q_sizes, q_splits, q_survivor

MODULES = (q_splits, q_matching, q_survivor, q_sizes, q_lookalikes)
QUERIES = {name: run for m in MODULES for name, run in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
