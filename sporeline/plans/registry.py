"""All registered queries over the driver's tables, and the SQL each is checked against."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("hit_queries", "interval_queries", "sequence_queries", "report_queries", "family_queries", "source_queries")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f"sporeline.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
