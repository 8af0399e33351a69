"""Fractional differencing as a window dot product."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import trailing


def weights(d: float, threshold: float = 1e-4, longest: int = 200) -> np.ndarray:
    """Binomial weights of (1 - L)^d, newest first, up to the first that falls under ``threshold``."""
    k = np.arange(1, longest)
    w = np.r_[1.0, np.cumprod((k - 1 - d) / k)]
    small = np.flatnonzero(np.abs(w) < threshold)
    return w[: small[0]] if len(small) else w


def fracdiff(df: DataFrame, c: Column, d: float, name: str) -> DataFrame:
    """NULL until the window holds as many values as there are weights."""
    w = weights(d)
    window = F.collect_list("_x").over(trailing(len(w)))  # NULLs are dropped, so a gap shortens the list
    coefficients = F.array(*[F.lit(float(v)) for v in w[::-1]])
    dot = F.aggregate(F.zip_with("_w", coefficients, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("_x", c).withColumn("_w", window).withColumn(name, F.when(F.size("_w") == len(w), dot)).drop("_x", "_w")
