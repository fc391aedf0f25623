"""Runnable catalogue: every query over the given tables, with its SQL twin."""

from __future__ import annotations

from importlib import import_module

from .registry import ORACLES, QUERIES

_MODULES = ("market", "relational", "ingest", "cleaning", "merges", "names", "texts")


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
