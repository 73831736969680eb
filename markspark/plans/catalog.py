"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from markspark.plans import q_analysis, q_attr, q_cases, q_eval, q_io, q_models, q_report, q_text  # noqa: F401
from markspark.plans.registry import REGISTRY


def queries() -> dict:
    return {name: q.fn for name, q in REGISTRY.items()}


def oracle_sql() -> dict:
    return {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}
