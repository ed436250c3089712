"""The registered queries of the lending platform."""

from __future__ import annotations

import importlib

MODULES = ("risk", "warehouse", "spatial", "dashboard", "changes", "valuation", "cleaning", "models", "ledger", "attribution", "files", "daily")
ALL: dict[str, tuple] = {}
for _name in MODULES:
    ALL |= importlib.import_module(f"terravane.plans.{_name}").QUERIES

FLAGSHIP = ALL["risk_class_summary"][0]


def queries():
    return {k: f for k, (f, _) in ALL.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in ALL.items() if sql}
