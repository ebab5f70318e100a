"""Queries over the driver's tables, grouped like the library."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "evaluation",
    "record_tables",
    "matching",
    "geometry",
    "boards",
    "mixtures",
    "collections",
    "streams",
)


def load_all():
    """Import every plan module; returns (queries, oracle texts)."""
    for name in MODULES:
        import_module(f"tallyfield.plans.{name}")
    from tallyfield.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
