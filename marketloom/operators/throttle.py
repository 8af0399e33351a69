"""Throttled downstream runs: of a key's triggers those that start a run, each at least ``gap`` after the run before.

A trigger's successor is the first one that may run after it.  The runs are the successors reached from a key's first trigger; they are found by
pointer jumping: round k adds the 2^k runs after those already found, so a key with a million runs takes twenty rounds, and no task ever holds
all triggers of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch
from .asof import asof_forward


def _written(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "throttle")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def runs_apart(triggers: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, time) of the triggers that run; ``gap`` is an interval such as ``12 hours``.

    Triggers of one key and time are one; null keys or times never run.
    """
    at = triggers.select(F.col(key).alias("key"), F.col(time).alias("at")).where("key IS NOT NULL AND at IS NOT NULL").distinct()
    at = _written(at)
    may = at.select("key", F.col("at").alias("from"), (F.col("at") + F.expr(f"interval {gap}")).alias("at"))
    jump = asof_forward(may, at.withColumn("next", F.col("at")), ["key"], "at", ["next"])
    jump = _written(jump.select("key", F.col("from").alias("at"), "next").where("next IS NOT NULL"))
    found = _written(at.groupBy("key").agg(F.min("at").alias("at")))
    parts = [found]
    while True:
        so_far = parts[0]
        for part in parts[1:]:
            so_far = so_far.unionByName(part)
        new = _written(so_far.join(jump, ["key", "at"]).select("key", F.col("next").alias("at")))
        if new.isEmpty():
            return so_far.select(F.col("key").alias(key), F.col("at").alias(time))
        parts.append(new)
        further = jump.select("key", F.col("at").alias("next"), F.col("next").alias("_after"))
        jump = _written(jump.join(further, ["key", "next"]).select("key", "at", F.col("_after").alias("next")))
