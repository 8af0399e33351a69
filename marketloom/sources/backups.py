"""Backups of several tables, and restoring some of them into keyed tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import KeyedTable, backup, exists, restore

META = "name string, n long, schema string, meta string"


def backup_all(tables: dict[str, DataFrame], path: str, meta: dict[str, str] | None = None) -> None:
    """Every table as gzipped JSON lines under its name, and one list of names, rows and schemas with what ``meta`` says of the backup.

    The list is written last: a backup that was cut off has none and cannot be restored.
    """
    for name, df in sorted(tables.items()):
        backup(df, f"{path}/tables/{name}")
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, restore(spark, f"{path}/tables/{name}", df.schema).count(), df.schema.json(), json.dumps(meta or {}, sort_keys=True)) for name, df in sorted(tables.items())]
    spark.createDataFrame(rows, META).coalesce(1).write.json(f"{path}/meta")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """name, n, schema and meta of the backup's tables."""
    if not exists(spark, f"{path}/meta/_SUCCESS"):
        raise ValueError(f"no whole backup at {path}")
    return spark.read.schema(META).json(f"{path}/meta")


def restored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of one table of the backup, with their types."""
    found = contents(spark, path).where(F.col("name") == name).first()
    if found is None:
        raise KeyError(f"the backup at {path} has no table {name}")
    return restore(spark, f"{path}/tables/{name}", StructType.fromJson(json.loads(found.schema)))


def restore_into(spark: SparkSession, path: str, targets: dict[str, KeyedTable], only: list[str] | None = None, apply: bool = False) -> DataFrame:
    """Put the tables of the backup (those in ``only``, if it names any) into their targets, and tell for each how many rows it has.

    Rows replace those of their keys, others of the target stay; without ``apply`` nothing is written.  Empty tables and tables without a target are left out.
    """
    found = contents(spark, path)
    names = [r.name for r in found.collect() if not only or r.name in only]
    for name in names if apply else []:
        if name in targets:
            rows = restored(spark, path, name)
            targets[name].upsert(rows, [F.col(c) for c in targets[name].keys])
    return found.where(F.col("name").isin(names)).select("name", "n")
