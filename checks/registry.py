"""All registered queries, by the name of the operator they exercise."""

from __future__ import annotations

import importlib

GROUPS = ["development", "users", "inventory", "silver"]


def merged(attribute: str) -> dict:
    out: dict = {}
    for group in GROUPS:
        part = getattr(importlib.import_module(f"checks.cases_{group}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out
