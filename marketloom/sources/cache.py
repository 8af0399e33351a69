"""Results cached by what they were made from: a fingerprint of the input files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import exists


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Changes with the names, sizes and times of the files under ``paths``; their content is not read.  A path without files counts as empty."""
    total = None
    for path in paths:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
        except AnalysisException:
            continue
        total = files if total is None else total.unionByName(files)
    if total is None:
        return "nothing"
    row = F.xxhash64("path", "length", "modificationTime")
    n, size, a, b = total.agg(F.count(F.lit(1)), F.sum("length"), F.expr("bit_xor(xxhash64(path, length, modificationTime))"), F.sum(row.cast("decimal(38,0)"))).first()
    return f"{n}-{size}-{a & (2**64 - 1):016x}-{int(b or 0) & (2**64 - 1):016x}"


class SourceCache:
    """Results by name under ``home``; an entry holds as long as its inputs' fingerprint does."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home, self.hits, self.builds = spark, home, 0, 0

    def _entry(self, name: str, version: str) -> str:
        return f"{self.home}/{name}/{version}"

    def get(self, name: str, inputs: list[str], build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
        """The stored result if there is one for these inputs as they are now; otherwise, or with ``rebuild``, it is built and stored.

        An entry counts once its marker is there, so a build that was cut off is built again.  Entries of earlier inputs stay until ``drop_stale``.
        """
        path = self._entry(name, fingerprint(self.spark, inputs))
        if rebuild or not exists(self.spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").parquet(path)
            self.builds += 1
        else:
            self.hits += 1
        return self.spark.read.parquet(path)

    def drop_stale(self, name: str, inputs: list[str]) -> None:
        """Remove all entries of the name but the current one."""
        current, root = fingerprint(self.spark, inputs), self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        store = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        for f in store.listStatus(root) if store.exists(root) else []:
            if f.getPath().getName() != current:
                store.delete(f.getPath(), True)
