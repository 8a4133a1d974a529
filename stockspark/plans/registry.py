"""Loads every catalog module and exposes the combined registries."""

from __future__ import annotations

import importlib

from stockspark.plans import catalog

_MODULES = ["q_reports", "q_ledger", "q_dims", "q_workflow", "q_quality", "q_paging", "q_lists", "q_intake",
            "q_functions", "q_streaming"]
_loaded = False


def load() -> None:
    global _loaded
    if _loaded:
        return
    for m in _MODULES:
        importlib.import_module(f"stockspark.plans.{m}")
    _loaded = True


def queries():
    load()
    return dict(catalog.QUERIES)


def oracle_sql():
    load()
    return dict(catalog.ORACLE)
