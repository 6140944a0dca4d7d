"""Queries and DuckDB SQL of the text operators."""

from __future__ import annotations

from . import decontaminate, langid, licenses, media, mixing, pages, runs, secrets, simhash, tokencount, tokenids, toxicity, turns

MODULES = [langid, decontaminate, simhash, licenses, toxicity, tokencount, tokenids, media, secrets, mixing, runs, pages, turns]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
