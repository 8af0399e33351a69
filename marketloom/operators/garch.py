"""Conditional volatility per symbol: GARCH(1,1) by maximum likelihood, with an exponentially weighted fallback.

    variance[t] = omega + alpha * return[t - 1] ** 2 + beta * variance[t - 1],    omega > 0, alpha, beta >= 0, alpha + beta < 1

Each symbol's history is one group; its recursion and the three derivatives are linear filters, so one evaluation of the
likelihood and its gradient is four passes in compiled code.  The constraints hold by the parametrisation (a softmax over alpha,
beta and the rest), and a quasi-Newton search starts from the best point of a small grid.

The variance before the first bar is a weighted mean of the first SEED squares.  Parameters see the whole series given; the
volatility of a bar sees only returns before it.  A series with fewer than LEAST returns, one without spread, or one whose fit is not finite
takes the exponentially weighted deviation (span SPAN, ten returns at least) instead, and its forecast grows with the root of the horizon.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .recursive import smooth

LEAST, SPAN, SEED, ROUNDS = 250, 20, 75, 200
SCHEMA = "symbol string, date date, vol double, vol_h double, model string, omega double, alpha double, beta double"


def start_variance(r: np.ndarray) -> float:
    """Weighted mean of the first squares, with decay 0.94."""
    weights = 0.94 ** np.arange(min(SEED, len(r)))
    return float(weights @ r[: len(weights)] ** 2 / weights.sum())


def _carry(inputs: np.ndarray, beta: float, first: float) -> np.ndarray:
    """y[t] = inputs[t] + beta * y[t - 1], with y[-1] = first."""
    beta = min(beta, 1 - 1e-12)
    return smooth(np.concatenate([[first], inputs / (1 - beta)]), 1 - beta)[1:]


def variances(r: np.ndarray, omega: float, alpha: float, beta: float, first: float) -> np.ndarray:
    before = np.concatenate([[first], r[:-1] ** 2])
    return _carry(omega + alpha * before, beta, first)


def _unpacked(theta: np.ndarray) -> tuple[float, float, float]:
    omega = float(np.exp(theta[0]))
    top = np.exp(theta[1:] - max(0.0, theta[1:].max()))
    rest = np.exp(-max(0.0, theta[1:].max()))
    alpha, beta = top / (top.sum() + rest)
    return omega, float(alpha), float(beta)


def _loss(theta: np.ndarray, r: np.ndarray, first: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood (without constants) and its gradient."""
    omega, alpha, beta = _unpacked(theta)
    before = np.concatenate([[first], r[:-1] ** 2])
    v = np.maximum(_carry(omega + alpha * before, beta, first), 1e-300)
    slope = (1 / v - r**2 / v**2) / (2 * len(r))
    by_omega, by_alpha = slope @ _carry(np.ones(len(r)), beta, 0.0), slope @ _carry(before, beta, 0.0)
    by_beta = slope @ _carry(np.concatenate([[first], v[:-1]]), beta, 0.0)
    spread = alpha * by_alpha + beta * by_beta
    return float((np.log(v) + r**2 / v).mean() / 2), np.array([omega * by_omega, alpha * (by_alpha - spread), beta * (by_beta - spread)])


def fit(r: np.ndarray) -> tuple[float, float, float] | None:
    """(omega, alpha, beta) of the largest likelihood found; None where no finite one is."""
    scale = float(r.std())
    if not np.isfinite(scale) or scale <= 0:
        return None
    z = r / scale
    first = start_variance(z)
    grid = [np.array([np.log(1 - a - b), np.log(a / (1 - a - b)), np.log(b / (1 - a - b))]) for a in (0.03, 0.08, 0.2) for b in (0.5, 0.75, 0.9) if a + b < 1]
    theta = min(grid, key=lambda t: _loss(t, z, first)[0])
    value, slope = _loss(theta, z, first)
    inverse = np.eye(3)
    for _ in range(ROUNDS):
        step = -inverse @ slope
        if step @ slope >= 0:  # no descent: start the curvature again
            inverse, step = np.eye(3), -slope
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        size = 1.0
        while size > 1e-10:
            new, new_slope = _loss(theta + size * step, z, first)
            if np.isfinite(new) and new <= value + 1e-4 * size * (step @ slope):
                break
            size /= 2
        else:
            break
        moved, turned = size * step, new_slope - slope
        theta, gain = theta + moved, value - new
        value, slope = new, new_slope
        if gain < 1e-12 and np.abs(slope).max() < 1e-6:
            break
        if (curve := moved @ turned) > 1e-14:
            part = np.eye(3) - np.outer(moved, turned) / curve
            inverse = part @ inverse @ part.T + np.outer(moved, moved) / curve
    omega, alpha, beta = _unpacked(theta)
    return (omega * scale**2, alpha, beta) if np.isfinite([omega, alpha, beta, value]).all() else None


def horizon_variance(v: np.ndarray, r: np.ndarray, omega: float, alpha: float, beta: float, horizon: int) -> np.ndarray:
    """Variance of the sum of the next ``horizon`` returns after each bar: forecasts that revert to omega / (1 - alpha - beta)."""
    ahead = omega + alpha * r**2 + beta * v
    total = np.zeros(len(r))
    for _ in range(max(1, horizon)):
        total += ahead
        ahead = omega + (alpha + beta) * ahead
    return total


def weighted_deviation(r: np.ndarray) -> np.ndarray:
    return pd.Series(r).ewm(span=SPAN, min_periods=10).std().to_numpy()


def volatility(r: np.ndarray, horizon: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, str, tuple[float, float, float]]:
    """Volatility of each bar, of the ``horizon`` bars after it, the model's name and its parameters."""
    found = fit(r) if len(r) >= least else None
    if found:
        v = variances(r, *found, start_variance(r))
        vol = np.sqrt(v)
        if np.isfinite(vol).all() and vol.std() > 0:
            return vol, np.sqrt(horizon_variance(v, r, *found, horizon)), "garch", found
    vol = weighted_deviation(r)
    return vol, vol * np.sqrt(max(1, horizon)), "ewma", (np.nan, np.nan, np.nan)


def conditional_volatility(returns: DataFrame, horizon: int = 5, least: int = LEAST) -> DataFrame:
    """One row per known return: symbol, date, vol, vol_h, model and parameters; from symbol, date, ``ret`` (decimal).

    Null, NaN and infinite returns are left out; a bar without a volatility yet is null; ties of date keep the order of ``ret``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.isfinite(pdf["ret"].astype(float))].sort_values(["date", "ret"], kind="stable")
        if pdf.empty:
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in SCHEMA.split(", ")})
        vol, ahead, model, (omega, alpha, beta) = volatility(pdf["ret"].to_numpy(dtype=float), horizon, least)
        known = lambda x: pd.array(np.where(np.isfinite(x), x, None), dtype="object")
        out = pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "date": pdf["date"].to_numpy(), "vol": known(vol), "vol_h": known(ahead), "model": model})
        return out.assign(**{name: [x if np.isfinite(x) else None] * len(out) for name, x in (("omega", omega), ("alpha", alpha), ("beta", beta))})

    return returns.select("symbol", "date", "ret").where("symbol IS NOT NULL").groupBy("symbol").applyInPandas(run, SCHEMA)
