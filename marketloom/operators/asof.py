"""Point-in-time joins by one sorted pass: union both sides, carry the last source row forward.

Both sides are shuffled once on the key; there is no range condition, so no quadratic step per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _stack(left: DataFrame, right: DataFrame, keys: list[str], time: str, carry: list[str], right_first: bool) -> DataFrame:
    r = right.select(*keys, F.col(time).alias("_t"), F.struct(F.col(time).alias("_source"), *carry).alias("_r"), F.lit(0 if right_first else 1).alias("_side"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_l"))
    lft = left.select(*keys, F.col(time).alias("_t"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(1 if right_first else 0).alias("_side"), F.struct(*left.columns).alias("_l"))
    return lft.unionByName(r)


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], time: str, carry: list[str], strict: bool = False, limit: int | None = None) -> DataFrame:
    """Left rows with the columns ``carry`` of the last right row at or before them (before them if ``strict``).

    A source row wins even if its values are NULL.  ``limit``: at most so many left rows that do not match the time of
    their source row exactly take its values, in time order.  Right rows must be unique by key and time.
    """
    rows = _stack(left, right, keys, time, carry, right_first=not strict)
    order = Window.partitionBy(*keys).orderBy("_t", "_side")
    rows = rows.withColumn("_m", F.last("_r", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_l is not null")
    value = F.col("_m")
    if limit is not None:
        inexact = (F.col("_t") != F.col("_m._source")).cast("int")
        since = F.sum(inexact).over(Window.partitionBy(*keys, "_m._source").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0))
        value = F.when(since <= limit, F.col("_m"))
    return rows.withColumn("_v", value).select("_l.*", *[F.col(f"_v.{c}").alias(c) for c in carry])


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], time: str, carry: list[str]) -> DataFrame:
    """Left rows with the columns of the first right row at or after them."""
    rows = _stack(left, right, keys, time, carry, right_first=False)
    order = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)  # from the last row back: one pass
    rows = rows.withColumn("_m", F.last("_r", ignorenulls=True).over(order)).where("_l is not null")
    return rows.select("_l.*", *[F.col(f"_m.{c}").alias(c) for c in carry])


def daily_spine(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Every day from the first to the last of each key."""
    spans = df.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    return spans.select(*keys, F.explode(F.sequence("_a", "_b")).alias(time))


def latest_per_group(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The newest rows of each group; rows that tie for newest all stay."""
    return df.withColumn("_rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(time)))).where("_rank = 1").drop("_rank")


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the last in ``order`` (descending sort columns)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
