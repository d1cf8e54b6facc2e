"""Named queries over the shared tables, grouped by the kind of operator they exercise."""

from __future__ import annotations

from importlib import import_module

from pressgrain.plans import registry

MODULES = ["text", "scalars", "reports", "rules", "storage", "streams", "sqlforms"]


def load():
    """Import every plan module once and return the filled registry."""
    for module in MODULES:
        import_module(f"pressgrain.plans.{module}")
    return registry
