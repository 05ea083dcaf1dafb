"""All registered queries: name -> (spark, sf_dir) -> DataFrame, plus the
DuckDB oracle SQL for the SQL-checkable ones."""

from __future__ import annotations

import importlib

_MODULES = ["q_credit", "q_application", "q_metrics", "q_text", "q_sampling", "q_models"]


def _registries():
    for m in _MODULES:
        yield importlib.import_module(f"riskloom.plans.{m}").R


def queries() -> dict:
    out: dict = {}
    for r in _registries():
        dup = set(out) & set(r.queries)
        if dup:
            raise KeyError(f"duplicate queries {dup}")
        out.update(r.queries)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for r in _registries():
        out.update(r.oracle)
    return out
