"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

import importlib

MODULES = ("scalars", "sources", "relational", "statistics", "sampling", "modelling", "suite")


def load():
    """(queries, oracle SQL), importing the query modules on first use."""
    from . import core

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return dict(core.QUERIES), dict(core.ORACLES)
