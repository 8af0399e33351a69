"""Models: what SQL cannot express, on small series with known answers."""

import datetime

import numpy as np
import pytest

from marketloom.operators import regimes
from marketloom.plans.learning import calibrated, calibration_error
from marketloom.plans.models import adf, least_order, out_of_fold

DAY = datetime.date(2020, 1, 1)


def test_folds_score_every_later_event_by_earlier_ones(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(140):
        for s in ("A", "B"):
            x = rng.normal(size=5)
            rows.append((s, DAY + datetime.timedelta(days=i), DAY + datetime.timedelta(days=i + 1), *map(float, x), float(x[3] + 0.3 * rng.normal() > 0)))
    df = spark.createDataFrame(rows, "symbol string, date date, t1 date, sma5 double, sma20 double, vol20 double, r1 double, r5 double, y double")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    size = len(rows) // 7
    want = {(r[0], r[1]): min(6, i // size) for i, r in enumerate(order) if i >= size}
    for model in ("logistic", "gbt"):
        got = out_of_fold(df, model).collect()
        assert {(r.symbol, r.date): r.fold for r in got} == want and len(got) == len(want)
        assert all(0 <= r.p <= 1 for r in got) and np.mean([(r.p > 0.5) == (r.y > 0.5) for r in got]) > 0.85


def test_calibration_uses_earlier_folds_only(spark):
    rows = [(0, 0.2, int(i < 10)) for i in range(100)] + [(0, 0.8, int(i < 90)) for i in range(100)] + [(1, p, 1) for p in (0.1, 0.2, 0.5, 0.8, 0.95)] * 30 + [(2, 0.8, 0)] * 10
    c = calibrated(spark.createDataFrame(rows, "fold int, meta_prob double, correct int"))
    got = {(r.fold, r.meta_prob): r.calibrated for r in c.collect()}
    assert [got[1, p] for p in (0.1, 0.2, 0.5, 0.8, 0.95)] == pytest.approx([0.1, 0.1, 0.5, 0.9, 0.9]) and {f for f, _ in got} == {1, 2}
    e = {r.fold: (r.ece, r.n) for r in calibration_error(c).collect()}
    assert e[1] == (pytest.approx((60 * 0.9 + 30 * 0.5 + 60 * 0.1) / 150), 150) and e[None] == e[1]  # fold 2 has ten rows only


def test_forward_filter_equals_enumeration():
    rng = np.random.default_rng(1)
    start, moves = np.array([0.5, 0.3, 0.2]), np.array([[0.8, 0.1, 0.1], [0.2, 0.7, 0.1], [0.3, 0.3, 0.4]])
    density = rng.normal(size=(5, 3))
    got = regimes.forward_filter(start, moves, density)
    belief = start * np.exp(density[0])
    for t in range(5):
        if t:
            belief = (belief @ moves) * np.exp(density[t])
        assert got[t] == pytest.approx(belief / belief.sum(), abs=1e-9)


def test_chain_finds_the_states_it_was_drawn_from(spark):
    rng = np.random.default_rng(2)
    centres = {0: (-1.0, 2.0, 3.0), 1: (2.0, 0.5, 0.0), 2: (0.0, 1.0, 1.0)}  # risk_off, trend, chop
    rows, truth, state = [], [], 1
    for i in range(700):
        state = state if rng.random() < 0.96 else int(rng.integers(3))
        truth.append(("risk_off", "trend", "chop")[state])
        x = np.array(centres[state]) + 0.25 * rng.normal(size=3)
        rows.append(("M", DAY + datetime.timedelta(days=i), *map(float, x)))
    rows += [("short", DAY + datetime.timedelta(days=i), 1.0 + i, 2.0, 3.0) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, date date, a double, b double, c double")
    got = regimes.decode(df, "symbol", ["a", "b", "c"]).orderBy("date").collect()
    assert len(got) == 700 and {r.symbol for r in got} == {"M"}
    assert np.mean([r.regime == t for r, t in zip(got, truth)]) > 0.95
    assert all(abs(r.p_risk_off + r.p_chop + r.p_trend - 1) < 1e-9 for r in got)
    early = regimes.decode(df.where("symbol = 'M'").limit(0), "symbol", ["a", "b", "c"])
    assert early.count() == 0
    cut = regimes.decode(spark.createDataFrame(rows[:650], df.schema), "symbol", ["a", "b", "c"]).orderBy("date").collect()
    whole = {r.date: r.p_trend for r in got}
    assert np.mean([abs(r.p_trend - whole[r.date]) for r in cut]) < 0.02  # later bars only move the fitted half


def test_dickey_fuller_against_least_squares(spark):
    rng = np.random.default_rng(3)
    walk, noise = np.cumsum(rng.normal(size=300)), rng.normal(size=300)
    rows = [(s, DAY + datetime.timedelta(days=i), float(v)) for s, xs in (("walk", walk), ("noise", noise), ("few", noise[:40])) for i, v in enumerate(xs)]
    got = {r.s: r for r in adf(spark.createDataFrame(rows, "s string, date date, x double"), ["s"]).collect()}
    for name, xs in (("walk", walk), ("noise", noise)):
        d = np.diff(xs)
        design = np.column_stack([np.ones(len(d) - 1), xs[1:-1], d[:-1]])
        coef, rest, *_ = np.linalg.lstsq(design, d[1:], rcond=None)
        se = np.sqrt(rest[0] / (len(d) - 1 - 3) * np.linalg.inv(design.T @ design)[1, 1])
        assert got[name].t == pytest.approx(coef[1] / se)
    assert got["noise"].stationary and not got["walk"].stationary and not got["few"].stationary and got["few"].t is None
    prices = spark.createDataFrame([("noise", d, float(np.exp(v))) for _, d, v in rows[300:600]], "symbol string, date date, close double")
    assert least_order(prices).first().d == 0.1
