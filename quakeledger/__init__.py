"""Audits of seismic event catalogs and preparation of their data, on PySpark DataFrames."""

from quakeledger.audit import Audit
from quakeledger.catalog import NUMBERS, REQUIRED, SCHEMA, TEXTS, canonical, seconds
from quakeledger.operators.decision import Thresholds

__all__ = ["NUMBERS", "REQUIRED", "SCHEMA", "TEXTS", "Audit", "Thresholds", "canonical", "seconds"]
