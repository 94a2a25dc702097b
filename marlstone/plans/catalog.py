"""The registered queries, by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import importlib

from marlstone.plans.base import QUERIES, SQL

MODULES = ("retrieval", "evaluation", "ledger", "telemetry", "answers", "text", "sections", "ingest", "contracts", "reports")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"marlstone.plans.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(SQL)
