"""Registered queries over the test tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import importlib

MODULES = ("fold_queries", "scan_queries", "cell_queries", "join_queries", "member_queries", "change_queries", "stream_queries")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"gridcells.plans.{m}").BOOK.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in importlib.import_module(f"gridcells.plans.{m}").BOOK.sql.items()}
