"""Exact ranks and quantiles against brute force."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerloom.functions.ranks import interpolated, quantiles, value_ranks

ODD = {"a": "0.07", "b": "0.5", "c": "0.9", "d": "1"}


def frame(spark, values):
    return spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "x double, g int")


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 1.0, 1.0], [None, 2.0, -1.0, None], [float(i % 7) for i in range(200)], [-1e12, 0.0, 1e-23, 1e12, 5.0]])
def test_ranks(spark, values):
    known = sorted(v for v in values if v is not None)
    got = {r.x: (r.copies, r.below, r.n) for r in value_ranks(frame(spark, values), "x").collect()}
    assert got == {v: (known.count(v), sum(w < v for w in known), len(known)) for v in set(known)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6).map(lambda v: round(v, 2) + 0.0)), min_size=1, max_size=40))
def test_quantiles(spark, values):
    known = sorted(v for v in values if v is not None)
    rows = quantiles(frame(spark, values), "x", ODD).collect()
    if known:
        exact = {"a": 7, "b": 50, "c": 90, "d": 100}
        assert all(rows[0][k] == known[-(-p * len(known) // 100) - 1] for k, p in exact.items())


def test_interpolated_and_groups(spark):
    values = [float(v) for v in (5, 1, 4, 2, 9, 9, 3, 7, 8)]
    got = {r.g: r.m for r in interpolated(frame(spark, values), "x", {"m": "0.3"}, ("g",)).collect()}
    for g in (0, 1):
        own = sorted(v for i, v in enumerate(values) if i % 2 == g)
        at = (len(own) - 1) * 0.3
        low = own[math.floor(at)]
        assert got[g] == pytest.approx(low + (own[math.floor(at) + 1] - low) * (at - math.floor(at)))
