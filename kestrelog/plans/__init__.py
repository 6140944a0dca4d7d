"""Registered queries over the given tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import importlib

from . import base

MODULES = ["ingest", "history", "units", "detect", "review", "views", "techniques", "cases", "guards", "trials", "streams"]
for _name in MODULES:
    importlib.import_module(f"{__name__}.{_name}")


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.ORACLE)
