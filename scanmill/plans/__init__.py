"""Registered queries, grouped by domain."""

from importlib import import_module

MODULES = ("analytics", "relational", "textual", "screened", "remembered", "streams", "learned")


def load():
    """Import every plan module and return (queries, oracles)."""
    for m in MODULES:
        import_module(f"scanmill.plans.{m}")
    from scanmill.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
