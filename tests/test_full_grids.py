"""The registered sweeps run on the whole grids of their operators."""

import inspect

import pytest

from locavec import fixtures as X
from locavec import registry
from locavec.operators import models
from locavec.plans import sweeps

QUERIES = registry.load()[0]


class Seen(Exception):
    pass


def arguments(monkeypatch, spark, sf, name, module, operator):
    """What the query hands to its operator, defaults included; the operator itself does not run."""
    own = inspect.signature(getattr(module, operator))

    def record(*a, **kw):
        bound = own.bind(*a, **kw)
        bound.apply_defaults()
        raise Seen(bound.arguments)

    monkeypatch.setattr(module, operator, record)
    with pytest.raises(Seen) as e:
        QUERIES[name](spark, sf)
    got = e.value.args[0]
    return got | got.get("kw", {})


@pytest.mark.parametrize("name, module, operator, want", [
    ("mdl5_nested_classification", models, "score_grid", {}),
    ("mdl11_evaluate_tasks", sweeps, "evaluate_tasks", {"alphas": models.RIDGE_ALPHAS}),
    ("mdl12_block_size_sweep", sweeps, "block_size_sweep", {"alphas": models.RIDGE_ALPHAS, "cells": sweeps.CELL_SIZES, "widths": X.WIDTHS}),
    ("mdl13_penalty_sweep", sweeps, "penalty_sweep", {"alphas": models.RIDGE_ALPHAS, "cells": sweeps.PENALTY_CELLS}),
    ("mdl14_interpolation_ladder", sweeps, "interpolation_sweep", {"cells": sweeps.CELL_SIZES, "ks": (1, 5, 20)}),
    ("mdl15_buffered_exclusion", sweeps, "buffered_sweep", {"alphas": models.RIDGE_ALPHAS, "radii": sweeps.RADII_KM}),
    ("mdl16_distance_error", sweeps, "distance_error_sweep", {"alphas": models.RIDGE_ALPHAS, "cells": sweeps.DISTANCE_CELLS}),
    ("mdl17_variogram_sweep", sweeps, "variogram", {"lags": sweeps.LAGS_KM, "pairs_per_lag": None, "widths": X.WIDTHS}),
    ("mdl7_logistic_c_sweep", models, "logistic_path", {"cs": models.LOGISTIC_CS, "max_iter": 500, "select": "test"}),
    ("mdl7_logistic_inner_choice", models, "logistic_path", {"cs": models.LOGISTIC_CS, "max_iter": 500, "select": "inner", "buckets": 5}),
])
def test_whole_grid(monkeypatch, spark, sf, name, module, operator, want):
    got = arguments(monkeypatch, spark, sf, name, module, operator)
    assert {k: tuple(v) if isinstance(v, list) else v for k, v in got.items() if k in want} == want
    assert tuple(got.get("alphas", models.RIDGE_ALPHAS)) == models.RIDGE_ALPHAS
    if operator == "variogram":
        assert got["polygons"] is not None
    if operator == "logistic_path":
        assert got["df"].select("fold").distinct().count() == 5
