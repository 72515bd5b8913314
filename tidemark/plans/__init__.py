"""Registered queries, one module per area."""

from __future__ import annotations

from importlib import import_module

from tidemark.plans import registry

MODULES = ["features", "quality", "evaluation", "drift", "labels", "service", "retrieval", "governance", "streaming", "models", "contracts"]


def _load() -> None:
    for name in MODULES:
        import_module(f"tidemark.plans.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracles():
    _load()
    return dict(registry.ORACLES)
