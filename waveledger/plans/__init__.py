"""Queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

from waveledger.plans.registry import ORACLES, QUERIES, Query

_MODULES = ["signal_queries", "spectral_queries", "catalog_queries", "evaluation_queries",
            "source_queries", "stream_queries", "model_queries"]


def _load() -> None:
    for name in _MODULES:
        import_module(f"waveledger.plans.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
