"""The SQL of tails holds for any argument, as the query's functions do."""

from __future__ import annotations

import duckdb
import pytest

from panelwright.functions import special
from panelwright.plans import oracle


@pytest.mark.parametrize("a", (0.5, 1.0, 2.5, 5.0, 24.0, 33.5))
@pytest.mark.parametrize("x", (0.3, 4.0, 24.0, 60.0, 380.0, 620.0, 5_000.0))
def test_gamma_tail(a, x):
    got = duckdb.connect().execute(f"SELECT {oracle._gamma_q('a', 'x')} FROM (SELECT {a}::DOUBLE AS a, {x}::DOUBLE AS x)").fetchone()[0]
    assert got == pytest.approx(special.gamma_q(a, x), abs=2e-11)


@pytest.mark.parametrize("z", (-3.0, 0.0, 1.5, 8.0, 17.0, 30.0, 60.0))
def test_normal_tail(z):
    got = duckdb.connect().execute(f"SELECT {oracle._normal_sf('z')} FROM (SELECT {z}::DOUBLE AS z)").fetchone()[0]
    assert got == pytest.approx(special.normal_sf(z), abs=2e-11)


def test_gamma_tail_of_null():
    assert duckdb.connect().execute(f"SELECT {oracle._gamma_q('a', 'x')} FROM (SELECT NULL::DOUBLE AS a, 1.0 AS x)").fetchone()[0] is None


def test_tails_of_statistics_that_are_not_rounded():
    assert "round(runs_z, 9)" not in oracle.sql()["randomness_tails"] and "round(ljung_box, 9)" not in oracle.sql()["randomness_tails"]
