"""All queries and oracle statements of this subpackage."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("packing", "fingerprints", "toxicity", "mixing", "jaccard", "sharding", "repeats", "chat", "licenses", "quality", "token_counts", "alignment", "filter_audit")


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in import_module(f"sessionrec.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for m in _MODULES for name, s in import_module(f"sessionrec.llm.{m}").SQL.items()}
