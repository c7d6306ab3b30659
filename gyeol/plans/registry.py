"""Registered queries and their SQL oracles."""

from __future__ import annotations

from . import korean, predicates, stats

MODULES = (stats, korean, predicates)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
