"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from importlib import import_module

MODULES = ("mixing", "packing", "urlfilter", "simhash", "embedding", "ctw", "tokenfile", "license", "toxicity", "quality", "divergence", "importance")


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__package__}.{m}"), name, {})
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE_SQL")
