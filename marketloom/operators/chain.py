"""A chain of steps that can be cut off anywhere and taken up again."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import exists

log = logging.getLogger(__name__)
Make = Callable[[dict[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Step:
    """``make`` gets the results of the steps before it by name.  If it fails and there is an ``otherwise``, that takes its place and the chain goes on."""

    name: str
    make: Make
    otherwise: Make | None = None


class Chain:
    """Steps in order; each result is written under ``home`` and recorded there once it is whole.

    A step that is recorded is never run again: its result is read.  So after a crash a new object over the same home begins with the step that
    was cut off, whose half-written result it overwrites, and later steps see exactly what they would have seen.  A step that took its
    ``otherwise`` is recorded as such and counts as done.  ``ran`` has the steps of this object's run, in order.
    """

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home, self.ran = spark, home, []

    def _record(self, name: str) -> str:
        return f"{self.home}/done/{name}"

    def status(self, name: str) -> str | None:
        """``made``, ``otherwise``, or None where the step is not done."""
        if not exists(self.spark, f"{self._record(name)}/_SUCCESS"):
            return None
        return self.spark.read.schema("status string").json(self._record(name)).first()[0]

    def run(self, steps: list[Step]) -> dict[str, DataFrame]:
        done: dict[str, DataFrame] = {}
        for step in steps:
            path = f"{self.home}/{step.name}"
            if self.status(step.name) is None:
                status = "made"
                try:
                    step.make(done).write.mode("overwrite").parquet(path)
                except Exception as error:
                    if step.otherwise is None:
                        raise
                    log.warning("step %s failed (%s), going on without it", step.name, error)
                    step.otherwise(done).write.mode("overwrite").parquet(path)
                    status = "otherwise"
                self.spark.createDataFrame([(status,)], "status string").coalesce(1).write.mode("overwrite").json(self._record(step.name))
                self.ran.append(step.name)
            done[step.name] = self.spark.read.parquet(path)
        return done
