"""The registered queries of the reconciliation operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ("matching", "listing", "trail", "ingest", "admin", "store")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"tally.plans.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
