"""Queries over the test tables, grouped by kind; each module has QUERIES and ORACLES."""

from __future__ import annotations

import importlib

MODULES = ("relational", "series", "models")


def _gather(name: str) -> dict:
    out = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"quarry.plans.{m}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLES")
