"""Market regimes: a three-state Gaussian hidden chain per series, fitted on its early part and filtered forward.

Each series (a market, a sector, a symbol) is a group of its own; a group is one row per bar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

STATES, ROUNDS, LEAST, FLOOR = 3, 40, 250, 1e-3


def _log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), STATES))
    for k in range(STATES):
        chol = np.linalg.cholesky(covs[k])
        z = np.linalg.solve(chol, (x - means[k]).T)
        out[:, k] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(chol)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_filter(start: np.ndarray, moves: np.ndarray, density: np.ndarray) -> np.ndarray:
    """P(state | observations so far), in logs and normalised at every step."""
    log_moves, out = np.log(moves + 1e-12), np.empty_like(density)
    now = np.log(start + 1e-12) + density[0]
    for t in range(len(density)):
        if t:
            now = density[t] + _log_sum(now[:, None] + log_moves, 0)
        now = now - _log_sum(now, 0)
        out[t] = now
    return np.exp(out)


def fit(x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, transitions, means and full covariances by expectation-maximisation, begun from thirds of the last column."""
    n, dims = x.shape
    third = np.argsort(np.argsort(x[:, -1], kind="stable"), kind="stable") * STATES // n
    start, moves = np.full(STATES, 1 / STATES), np.full((STATES, STATES), 0.05) + np.eye(STATES) * 0.85
    means = np.array([x[third == k].mean(axis=0) for k in range(STATES)])
    covs = np.array([np.cov(x[third == k].T).reshape(dims, dims) + FLOOR * np.eye(dims) for k in range(STATES)])
    for _ in range(rounds):
        density = _log_density(x, means, covs)
        ahead, log_moves = forward_filter(start, moves, density), np.log(moves + 1e-12)
        back = np.zeros((n, STATES))
        for t in range(n - 2, -1, -1):
            back[t] = _log_sum(log_moves + (density[t + 1] + back[t + 1])[None, :], 1)
            back[t] -= back[t].max()
        seen = np.log(ahead + 1e-300) + back
        seen = np.exp(seen - _log_sum(seen, 1)[:, None])
        pairs = np.log(ahead[:-1, :, None] + 1e-300) + log_moves[None] + (density[1:] + back[1:])[:, None, :]
        pairs = np.exp(pairs - _log_sum(_log_sum(pairs, 2), 1)[:, None, None])
        start, moves = seen[0], pairs.sum(axis=0) / pairs.sum(axis=(0, 2))[:, None]
        weight = seen.sum(axis=0)
        means = seen.T @ x / weight[:, None]
        for k in range(STATES):
            away = x - means[k]
            covs[k] = (seen[:, k, None] * away).T @ away / weight[k] + FLOOR * np.eye(dims)
    return start, moves, means, covs


def named(means: np.ndarray) -> list[str]:
    """Names of the states: risk_off has the highest fear (last column), trend the highest trend (first) of the others, chop is the rest."""
    fear = int(means[:, -1].argmax())
    trend = max((k for k in range(STATES) if k != fear), key=lambda k: means[k, 0])
    return ["risk_off" if k == fear else "trend" if k == trend else "chop" for k in range(STATES)]


def decode(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, date, regime, p_risk_off, p_chop, p_trend) of every bar whose columns are all known.

    The chain is fitted on the first half of the series (at least LEAST bars, or all there are) and standardised by it; a series with
    fewer than ten bars in each state's share gives nothing.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=columns).sort_values("date")
        x = pdf[columns].to_numpy(dtype=float)
        train = x[: max(LEAST, len(x) // 2)]
        if len(train) < 10 * STATES:
            return pdf.iloc[:0][[key, "date"]].assign(regime="", p_risk_off=0.0, p_chop=0.0, p_trend=0.0)
        spread = train.std(axis=0, ddof=1)
        mean, spread = train.mean(axis=0), np.where(spread > 0, spread, 1.0)
        start, moves, means, covs = fit((train - mean) / spread)
        p = forward_filter(start, moves, _log_density((x - mean) / spread, means, covs))
        names = named(means)
        out = pd.DataFrame({key: pdf[key].to_numpy(), "date": pdf["date"].to_numpy(), "regime": [names[k] for k in p.argmax(axis=1)]})
        return out.assign(**{f"p_{name}": p[:, names.index(name)] for name in ("risk_off", "chop", "trend")})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "date", *columns).groupBy(key).applyInPandas(run, f"{key} {kind}, date date, regime string, p_risk_off double, p_chop double, p_trend double")
