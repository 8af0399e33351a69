"""Event labels and cross-validation splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import by


def triple_barrier(df: DataFrame, vol: str, horizon: int = 5, pt: float = 1.0, sl: float = 1.0) -> DataFrame:
    """Per event the first touch of +pt*vol or -sl*vol within the horizon, else the last bar in reach.

    Needs symbol, date, close and ``vol``; adds barrier (pt, sl, timeout), ret, t1 and label (sign).  The horizon is a constant
    number of bars, so leads suffice and nothing is joined.
    """
    steps = range(1, horizon + 1)
    df = df.select("*", *[F.lead("close", j).over(by()).alias(f"_c{j}") for j in steps], *[F.lead("date", j).over(by()).alias(f"_d{j}") for j in steps])
    df = df.where(F.col("_c1").isNotNull() & (F.col(vol) > 0))
    ret = lambda j: F.col(f"_c{j}") / F.col("close") - 1
    touch = [F.when(ret(j) >= pt * F.col(vol), F.struct(F.lit("pt").alias("barrier"), ret(j).alias("ret"), F.col(f"_d{j}").alias("t1"))).when(ret(j) <= -sl * F.col(vol), F.struct(F.lit("sl").alias("barrier"), ret(j).alias("ret"), F.col(f"_d{j}").alias("t1"))) for j in steps]
    last = [F.when(F.col(f"_c{j}").isNotNull(), F.struct(F.lit("timeout").alias("barrier"), ret(j).alias("ret"), F.col(f"_d{j}").alias("t1"))) for j in reversed(steps)]
    df = df.withColumn("_hit", F.coalesce(*touch, *last)).drop(*[f"_{k}{j}" for k in "cd" for j in steps])
    return df.select("*", "_hit.*", F.signum("_hit.ret").cast("int").alias("label")).drop("_hit")


def uniqueness(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Mean of 1/concurrency over each event's span [date, t1], scaled to mean 1 per symbol: symbol, date, weight."""
    at = positions.select("symbol", "date", F.row_number().over(by()).alias("pos"))
    spans = events.select("symbol", "date", "t1").join(at.withColumnRenamed("pos", "a"), ["symbol", "date"]).join(at.select("symbol", F.col("date").alias("t1"), F.col("pos").alias("b")), ["symbol", "t1"])
    cells = spans.select("symbol", "date", F.explode(F.sequence("a", "b")).alias("pos"))
    crowd = cells.groupBy("symbol", "pos").agg(F.count(F.lit(1)).alias("n"))
    mean = cells.join(crowd, ["symbol", "pos"]).groupBy("symbol", "date").agg(F.avg(1 / F.col("n")).alias("u"))
    return mean.select("symbol", "date", (F.col("u") / F.avg("u").over(Window.partitionBy("symbol"))).alias("weight"))


def pooled_position(df: DataFrame, time: str, tie: list[str]) -> DataFrame:
    """Adds ``pos``, the row's place in order of (time, tie), counted by date first so that no task sees all rows."""
    days = df.groupBy(time).agg(F.count(F.lit(1)).alias("_n"))
    days = days.select(time, F.coalesce(F.sum("_n").over(Window.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(time).orderBy(*tie)) - 1
    return df.withColumn("_in", inside).join(days, time).withColumn("pos", F.col("_before") + F.col("_in")).drop("_in", "_before")


def purged_folds(events: DataFrame, k: int = 5, embargo: int = 7, whole: bool = False) -> DataFrame:
    """Walk-forward folds over pooled events (with ``pos`` and t1): fold, role (train or test) and the event's columns.

    Training events lie before the test block and end before the event ``embargo`` rows ahead of it.
    With ``whole`` the last test block takes the events that the division leaves over.
    """
    n = events.agg(F.max("pos").alias("m")).first()["m"]
    size = ((n if n is not None else -1) + 1) // (k + 1)
    starts = [(f, f * size, n + 1 if whole and f == k and n is not None else (f + 1) * size, max(0, f * size - embargo)) for f in range(1, k + 1)]
    at = {r["pos"]: r["date"] for r in events.where(F.col("pos").isin([s[3] for s in starts])).select("pos", "date").collect()}  # k rows
    bounds = events.sparkSession.createDataFrame([(f, a, b, at.get(c)) for f, a, b, c in starts], "fold int, _from long, _to long, _before date")
    test = (F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_to"))
    train = (F.col("pos") < F.col("_from")) & (F.col("t1") < F.col("_before"))
    role = F.when(test, "test").when(train, "train")
    return events.crossJoin(F.broadcast(bounds)).withColumn("role", role).where("role is not null").drop("_from", "_to", "_before")  # k bounds per event, k fixed
