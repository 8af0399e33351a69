"""Scores of forecasts: ranking, calibration, coverage."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGES = [float(x) for x in np.linspace(0.0, 1.0, 11)]


def auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Exact tie-aware ROC AUC.

    Counts per distinct score are cumulated inside 1,000 score bands and then over the bands, so no window spans
    all scores.
    """
    band = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p))) * 1000)
    by_score = df.groupBy(band.alias("band"), F.col(p).alias("p")).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    bands = by_score.groupBy("band").agg(F.sum("neg").alias("n"))
    bands = bands.select("band", F.coalesce(F.sum("n").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("band").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    scored = by_score.withColumn("_in", inside).join(bands, "band")
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("_in") + F.col("neg") / 2))
    return scored.agg((wins / F.nullif(F.sum("pos").cast("double") * F.sum("neg"), F.lit(0.0))).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def decile(p: Column) -> Column:
    """Bin of [0, 1) by the edges of ten equal bins; NULL for 1.0, which belongs to none."""
    bins = F.lit(-1)
    for e in EDGES:
        bins = bins + (p >= e).cast("int")
    return F.when(p < EDGES[-1], bins)


def ece(df: DataFrame, y: str, p: str) -> DataFrame:
    """Expected calibration error over ten half-open bins; all rows count in the denominator."""
    total = df.agg(F.count(F.lit(1)).alias("n"))
    bins = df.where(F.col(p) < 1).groupBy(decile(F.col(p)).alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.abs(F.avg(p) - F.avg(y)).alias("gap"))
    return bins.crossJoin(F.broadcast(total)).agg((F.sum(F.col("k") * F.col("gap")) / F.max("n")).alias("ece"), F.max("n").alias("n"))  # one row


def drift(df: DataFrame, keys: list[str], y: str, p: str, least: int = 200, floor: float = 0.48, ceiling: float = 0.10) -> DataFrame:
    """Per key: n, accuracy and calibration error (NULL under ``least`` outcomes), and whether one of them drifts."""
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("_acc"))
    bins = df.where(F.col(p) < 1).groupBy(*keys, decile(F.col(p)).alias("_bin")).agg(F.count(F.lit(1)).alias("_k"), F.abs(F.avg(p) - F.avg(y)).alias("_gap"))
    gaps = bins.groupBy(*keys).agg(F.sum(F.col("_k") * F.col("_gap")).alias("_gaps"))
    out = sums.join(gaps, keys, "left").withColumn("_ece", F.coalesce("_gaps", F.lit(0.0)) / F.col("n"))
    enough = F.col("n") >= least
    return out.select(
        *keys, "n", F.when(enough, F.col("_acc")).alias("accuracy"), F.when(enough, F.col("_ece")).alias("ece"),
        (enough & ((F.col("_acc") < floor) | (F.col("_ece") > ceiling))).alias("drift"),
    )


def with_rank(df: DataFrame, key: Column, order: list, bands: int = 1000) -> DataFrame:
    """Adds ``rank`` from 1 in ``order``; ``key`` in [0, 1) must rise with the order and deals rows into bands."""
    df = df.withColumn("_band", F.floor(key * bands))
    sizes = df.groupBy("_band").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_band", F.coalesce(F.sum("_n").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_band").orderBy(*order))
    return df.withColumn("_in", inside).join(sizes, "_band").withColumn("rank", F.col("_before") + F.col("_in")).drop("_band", "_in", "_before")


def conformal(df: DataFrame, score: str, alphas: list[float]) -> DataFrame:
    """Per alpha the conformal quantile (an order statistic, infinite if there are too few scores) and its coverage."""
    stats = df.agg(F.count(score).alias("n"), F.max(score).alias("top")).first()
    n, top = stats["n"], stats["top"] or 1.0
    levels = {a: math.ceil((n + 1) * (1 - a)) / n if n else 2.0 for a in alphas}
    places = {a: math.ceil(level * (n - 1)) + 1 for a, level in levels.items() if level <= 1}
    ranked = with_rank(df.where(F.col(score).isNotNull()), F.col(score) / (top * 1.001 or 1.0), [F.col(score)])
    found = {r["rank"]: r[score] for r in ranked.where(F.col("rank").isin(list(places.values()))).select("rank", score).collect()}
    rows = [(float(a), found[places[a]] if a in places else float("inf")) for a in alphas]
    q = df.sparkSession.createDataFrame(rows, "alpha double, q double")
    return df.crossJoin(F.broadcast(q)).groupBy("alpha", "q").agg(F.avg((F.col(score) <= F.col("q")).cast("double")).alias("coverage"), F.count(score).alias("n"))  # a row per alpha
