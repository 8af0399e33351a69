"""Helpers shared by the training-data operators: shared storage, row order, prefix sums."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset (tests)."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="marketloom-")
        context.setCheckpointDir(base)
    return base


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


MAP_BITS = 23


def bit_map(df: DataFrame, column: str) -> np.ndarray:
    """One bit for each slot that some value of a long column falls into: 2^MAP_BITS bits, however many values there are."""
    slots = df.select(F.col(column).bitwiseAND(F.lit((1 << MAP_BITS) - 1).cast("long")).alias("slot"))
    parts = slots.groupBy(F.shiftright("slot", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 5), dtype=np.uint32)
    out[parts.column("at").to_numpy()] = parts.column("bits").to_numpy()
    return out


def in_bit_map(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the (unsigned 64-bit) values may be in the map."""
    slot = values & np.uint64((1 << MAP_BITS) - 1)
    return ((bits[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).astype(bool)


def salted_join(many: DataFrame, one: DataFrame, keys: str | list[str], by: str, salts: int = 8) -> DataFrame:
    """Inner join with a side that has one row per key; a hot key's rows are dealt to ``salts`` tasks by a hash of ``by``."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    one = one.withColumn("_salt", F.explode(F.expr(f"sequence(0, {salts - 1})")))
    return many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(one, [*keys, "_salt"]).drop("_salt")


def with_prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], tag: str) -> DataFrame:
    """Add, for each ``{new: column}`` of ``sums``, the sum of ``column`` over all rows before this one in ``order``.

    Rows are range-partitioned by ``order``, so a value that holds a third of the rows is split wherever
    a later order column differs.  Running sums stay inside a partition; only one row per partition
    (bounded by the shuffle partition count) is ordered globally.  ``order`` should be a total order.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed, tag).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{n}") for n, c in sums.items()])
    out = out.join(F.broadcast(parts), "_part")  # one row for each range partition
    keep = [c for c in df.columns]
    return out.select(*keep, *[(F.col(f"_in_{n}") + F.col(f"_base_{n}")).alias(n) for n in sums])
