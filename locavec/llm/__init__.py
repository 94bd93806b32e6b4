"""Operators for preparing language-model training data, and their registered queries."""

from __future__ import annotations


def load():
    """(queries, oracle SQL) of this subpackage."""
    from . import queries

    return dict(queries.QUERIES), dict(queries.ORACLES)
