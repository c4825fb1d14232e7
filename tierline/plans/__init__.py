"""Registry of the checked queries: key -> (callable(spark, sf_dir), oracle SQL)."""

from __future__ import annotations

import importlib

_MODULES = ["silver", "gold", "sources_sinks", "windows", "features", "models", "series", "streams"]


def _collect():
    queries, oracles = {}, {}
    for m in _MODULES:
        mod = importlib.import_module(f"tierline.plans.{m}")
        for k in mod.QUERIES:
            if k in queries:
                raise KeyError(f"duplicate query key {k}")
        queries.update(mod.QUERIES)
        oracles.update(getattr(mod, "ORACLES", {}))
    return queries, oracles


def all_queries():
    return _collect()[0]


def all_oracles():
    return _collect()[1]
