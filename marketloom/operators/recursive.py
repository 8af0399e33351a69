"""Exponential smoothing: recursions along a symbol's history.

Spark has no recursive window, so each symbol's series runs through one grouped task as arrays; a group is one
symbol's history (thousands of bars), and symbols spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def smooth(x: np.ndarray, alpha: float, min_periods: int = 0) -> np.ndarray:
    """Recursive mean seeded with the first value; a missing value keeps the mean and ages its weight."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=min_periods).mean().to_numpy()


def smoothed(df: DataFrame, specs: dict[str, tuple[str, float, int]]) -> DataFrame:
    """Add columns ``{new: (column, alpha, min_periods)}`` per symbol in date order; later ones may use earlier ones."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        for name, (column, alpha, least) in specs.items():
            values = smooth(pd.to_numeric(pdf[column]).to_numpy(dtype=float, na_value=np.nan), alpha, least)
            pdf[name] = pd.array(np.where(np.isnan(values), None, values), dtype="object")
        return pdf

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{n} double" for n in specs])
    return df.groupBy("symbol").applyInPandas(run, schema)


def span(n: int) -> float:
    return 2 / (n + 1)


def smooth_sql(source: str, column: str, alpha: float, name: str, min_periods: int = 0) -> str:
    """Named queries (to follow WITH RECURSIVE) that compute the same from ``source`` (symbol, date, column): symbol, date, y."""
    return f"""{name}_s AS (SELECT symbol, date, {column}::DOUBLE AS x, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, count({column}) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS seen FROM {source}),
{name}_r AS (SELECT symbol, date, rn, seen, x AS y, 1::DOUBLE AS old FROM {name}_s WHERE rn = 1
  UNION ALL SELECT s.symbol, s.date, s.rn, s.seen,
    CASE WHEN s.x IS NULL THEN e.y WHEN e.y IS NULL THEN s.x ELSE (e.old * (1 - {alpha!r}::DOUBLE) * e.y + {alpha!r}::DOUBLE * s.x) / (e.old * (1 - {alpha!r}::DOUBLE) + {alpha!r}::DOUBLE) END,
    CASE WHEN s.x IS NULL AND e.y IS NOT NULL THEN e.old * (1 - {alpha!r}::DOUBLE) ELSE 1::DOUBLE END
  FROM {name}_r e JOIN {name}_s s ON s.symbol = e.symbol AND s.rn = e.rn + 1),
{name} AS (SELECT symbol, date, CASE WHEN seen >= {min_periods} THEN y END AS y FROM {name}_r)"""
