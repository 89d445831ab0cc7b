"""All queries with their check SQL."""

from __future__ import annotations

import importlib

MODULES = ["catalog", "search", "tables", "audit", "nutrition", "pages", "jobs", "publish", "streams"]


def all_queries() -> dict:
    out = {}
    for name in MODULES:
        out.update(importlib.import_module(f"larder.plans.{name}").QUERIES)
    return out
