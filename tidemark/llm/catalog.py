"""All queries of this subpackage and their checking SQL by name."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "language_id", "toxicity", "fixity", "suffix_dedup", "token_counts",
    "vector_dedup", "exact_dedup", "mixing", "byte_bpe", "simhash",
    "phrases", "pieces", "negatives",
]


def queries() -> dict:
    return {n: q for m in MODULES for n, q in import_module(f"tidemark.llm.{m}").QUERIES.items()}


def oracles() -> dict[str, str]:
    return {n: s for m in MODULES for n, s in getattr(import_module(f"tidemark.llm.{m}"), "ORACLES", {}).items()}
