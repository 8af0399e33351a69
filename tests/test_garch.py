"""GARCH(1,1): parameters recovered on simulated series, the gradient, the fallback and the forecast."""

import numpy as np
import pandas as pd
import pytest

from marketloom.operators import garch


def simulated(n, omega, alpha, beta, seed):
    rng = np.random.default_rng(seed)
    v, out = omega / (1 - alpha - beta), []
    for z in rng.standard_normal(n):
        out.append(np.sqrt(v) * z)
        v = omega + alpha * out[-1] ** 2 + beta * v
    return np.array(out)


@pytest.mark.parametrize("omega, alpha, beta", [(2e-6, 0.08, 0.90), (1e-5, 0.20, 0.70), (5e-5, 0.10, 0.50)])
def test_parameters_are_recovered(omega, alpha, beta):
    found = np.array([garch.fit(simulated(6000, omega, alpha, beta, seed)) for seed in range(4)])
    assert np.abs(found[:, 1].mean() - alpha) < 0.02 and np.abs(found[:, 2].mean() - beta) < 0.08
    long_run = np.sqrt(found[:, 0] / (1 - found[:, 1] - found[:, 2]))
    assert np.abs(long_run / np.sqrt(omega / (1 - alpha - beta)) - 1).max() < 0.15
    assert (found > 0).all() and (found[:, 1] + found[:, 2] < 1).all()


def test_no_point_near_the_fit_is_more_likely():
    r = simulated(1500, 2e-6, 0.1, 0.85, 9)
    omega, alpha, beta = garch.fit(r)
    first = garch.start_variance(r)

    def loss(o, a, b):
        v = [first]
        for t in range(len(r)):
            v.append(o + a * (first if t == 0 else r[t - 1] ** 2) + b * v[-1])  # plain recursion
        v = np.array(v[1:])
        return np.log(v).sum() + (r**2 / v).sum()

    best = loss(omega, alpha, beta)
    for o in (0.9, 1, 1.1):
        for a in (-0.01, 0, 0.01):
            for b in (-0.01, 0, 0.01):
                assert loss(omega * o, max(0, alpha + a), beta + b) >= best - 1e-3
    v = garch.variances(r, omega, alpha, beta, first)
    assert np.isclose(np.log(v).sum() + (r**2 / v).sum(), best)


def test_the_gradient_is_that_of_the_loss():
    r = simulated(400, 2e-6, 0.1, 0.8, 2) / 0.01
    theta = np.array([-2.0, 0.3, 1.4])
    _, slope = garch._loss(theta, r, garch.start_variance(r))
    for k in range(3):
        up, down = theta.copy(), theta.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        first = garch.start_variance(r)
        assert np.isclose((garch._loss(up, r, first)[0] - garch._loss(down, r, first)[0]) / 2e-5, slope[k], rtol=1e-4, atol=1e-8)


def test_volatility_sees_no_later_return_and_follows_clusters():
    rng = np.random.default_rng(0)
    r = rng.normal(0, np.r_[np.full(400, 0.01), np.full(200, 0.04), np.full(400, 0.01)])
    vol, ahead, model, _ = garch.volatility(r, 5)
    assert model == "garch" and vol[450:550].mean() > 2 * vol[100:300].mean() and (ahead > vol).all()
    changed = r.copy()
    changed[700:] *= 3
    v = garch.variances(changed, *garch.fit(r), garch.start_variance(r))
    assert np.allclose(np.sqrt(v[:701]), vol[:701])


def test_forecast_reverts_to_the_long_run():
    omega, alpha, beta = 1e-5, 0.1, 0.8
    v, r = np.array([4e-4]), np.array([0.05])
    far = garch.horizon_variance(v, r, omega, alpha, beta, 4000) - garch.horizon_variance(v, r, omega, alpha, beta, 3999)
    assert np.isclose(far[0], omega / (1 - alpha - beta))
    one = omega + alpha * 0.05**2 + beta * 4e-4
    assert np.isclose(garch.horizon_variance(v, r, omega, alpha, beta, 2)[0], one + omega + 0.9 * one)


def test_short_and_flat_series_fall_back():
    r = simulated(249, 2e-6, 0.1, 0.85, 1)
    vol, ahead, model, _ = garch.volatility(r, 4)
    assert model == "ewma" and np.isnan(vol[8]) and np.isclose(vol[-1], pd.Series(r).ewm(span=20, min_periods=10).std().iloc[-1]) and np.isclose(ahead[-1], 2 * vol[-1])
    assert garch.volatility(np.zeros(400), 5)[2] == "ewma"


def test_groups_with_nulls_and_no_rows(spark):
    r = simulated(300, 2e-6, 0.1, 0.85, 3)
    days = pd.date_range("2020-01-01", periods=300).date
    rows = [("A", d, float(x)) for d, x in zip(days, r)] + [("A", days[0], None), ("A", days[1], float("nan")), ("A", days[2], float("inf")), ("B", days[0], 0.01), ("N", days[0], None), (None, days[0], 0.1)]
    df = spark.createDataFrame(rows, "symbol string, date date, ret double").selectExpr("*", "1 as vol", "'x' as model")
    got = garch.conditional_volatility(df).toPandas()
    a = got[got.symbol == "A"].sort_values("date")
    assert len(a) == 300 and set(a.model) == {"garch"} and np.allclose(a.vol.astype(float), garch.volatility(r, 5)[0])
    b = got[got.symbol == "B"]
    assert len(b) == 1 and b.vol.isna().all() and set(b.model) == {"ewma"} and len(got) == 301
    assert garch.conditional_volatility(df.limit(0)).count() == 0
