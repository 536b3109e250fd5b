"""Named queries over the given tables."""

from __future__ import annotations

import importlib

from clauselake.plans.registry import ORACLES, QUERIES, Query

MODULES = ["search", "structure", "cleaning", "dialogue", "lookup", "checks", "metrics", "flow"]


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every query module and return the registered queries and checks."""
    for name in MODULES:
        importlib.import_module(f"clauselake.plans.{name}")
    return QUERIES, ORACLES
