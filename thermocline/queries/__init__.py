"""Registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("seam", "lifecycle", "preparation")


def _modules():
    for name in MODULES:
        yield importlib.import_module(f"thermocline.queries.{name}")


def all_queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def all_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
