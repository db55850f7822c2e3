"""Registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scans", "flows", "analytics", "models", "streams")


def load():
    """(queries, sql) after importing every module that registers some."""
    from leakscope.plans.registry import ORACLES, QUERIES
    for name in MODULES:
        import_module(f"leakscope.plans.{name}")
    return dict(QUERIES), dict(ORACLES)
