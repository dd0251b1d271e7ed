"""All registered queries and their checking SQL by name."""

from __future__ import annotations

from importlib import import_module

AREAS = ["windows", "store", "serving", "wire", "contracts", "monitor", "streams"]


def queries() -> dict:
    return {name: q for area in AREAS for name, q in import_module(f"tidemark.plans.{area}").QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: s for area in AREAS for name, s in import_module(f"tidemark.plans.{area}").ORACLES.items()}
