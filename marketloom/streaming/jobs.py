"""Streaming operators over a tick stream (id, symbol, ts, price, ...), event time with watermarks."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import KeyedTable, scratch


def stream_of(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """File stream over a Parquet table, a folder or a single file (which the source only takes as a pattern)."""
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(pattern)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there (one ``availableNow`` run) into Parquet with a checkpoint, and read the result."""
    spark = stream.sparkSession
    base = scratch(spark, f"stream-{name}")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
    writer.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def drain_upserts(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an update-mode stream; each micro-batch's rows replace those of their keys (the newest batch wins)."""
    spark = stream.sparkSession
    base = scratch(spark, f"stream-{name}")
    spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0)).write.parquet(f"{base}/out/batch=-1")

    def put(batch: DataFrame, number: int) -> None:  # idempotent: a repeated batch overwrites its own folder
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(put).start().awaitTermination()
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema]
    rows = spark.read.schema(", ".join([*fields, "_batch int"])).parquet(f"{base}/out")  # also where no micro-batch ran
    return rows.groupBy(*keys).agg(*[F.max_by(c, "_batch").alias(c) for c in rows.columns if c not in (*keys, "_batch")])


def drain_complete(stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregating stream in complete mode; the last micro-batch holds the whole result."""
    spark = stream.sparkSession
    base = scratch(spark, f"stream-{name}")
    done: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")
        done.append(number)

    stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/{done[-1]}") if done else spark.createDataFrame([], stream.schema)


def upsert_into(stream: DataFrame, table: KeyedTable, order: list[Column], name: str, checkpoint: str) -> None:
    """Run a stream over all that is there into a keyed table; its micro-batches replace rows of their keys, each exactly once.

    The table records the number of a micro-batch with the version it makes, so one that Spark runs again (the driver was lost between
    the write and the stream's own commit) changes nothing.  The next call goes on where the checkpoint says.
    """

    def put(batch: DataFrame, number: int) -> None:
        table.upsert(batch, order, batch=(name, number))

    stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start().awaitTermination()


def expiring_cache(operations: DataFrame) -> DataFrame:
    """A cache with a time to live per value, as keyed state with timers.

    ``operations`` (with a watermark on ``ts``): key, id, ts, op (``set``, ``get`` or ``invalidate``), value, ttl in seconds.  In order of time and id, a
    set replaces the key's value and its deadline, an invalidation drops both, and a get gives one row: ``hit`` with the value
    up to the deadline, the deadline itself included, and ``miss`` otherwise.  When the watermark passes the deadline, the timer drops the
    value and gives one row ``expired``; a key without a value holds no state.  Null keys and other operations are ignored.
    """
    kinds = {f.name: f.dataType.simpleString() for f in operations.schema}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            value, _ = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "id": pd.array([None], dtype="Int64"), "result": ["expired"], "value": [value]})
            return
        held = state.get if state.exists else None  # value, deadline in microseconds
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        out: list[tuple] = []
        times = rows["ts"].astype("datetime64[us]").astype("int64")
        for now, i, op, value, ttl in zip(times, rows["id"], rows["op"], rows["value"], rows["ttl"]):
            if op == "set":
                held = (value, int(now + float(ttl) * 1e6))
            elif op == "invalidate":
                held = None
            elif op == "get":
                hit = held is not None and now <= held[1]
                out.append((i, "hit" if hit else "miss", held[0] if hit else None))
        if held is None:
            if state.exists:
                state.remove()
        elif held[1] // 1000 + 1 <= state.getCurrentWatermarkMs():
            out.append((None, "expired", held[0]))
            if state.exists:
                state.remove()
        else:
            state.update(held)
            state.setTimeoutTimestamp(held[1] // 1000 + 1)
        if out:
            yield pd.DataFrame({"key": key[0], "id": pd.array([o[0] for o in out], dtype="Int64"), "result": [o[1] for o in out], "value": pd.array([o[2] for o in out], dtype="object")})

    known = operations.where("key IS NOT NULL AND op IN ('set', 'get', 'invalidate') AND NOT (op = 'set' AND (ttl IS NULL OR value IS NULL))")
    known = known.select("key", "id", "ts", "op", "value", F.col("ttl").cast("double").alias("ttl"))
    return known.groupBy("key").applyInPandasWithState(run, f"key {kinds['key']}, id long, result string, value {kinds['value']}", f"value {kinds['value']}, deadline long", "append", "EventTimeTimeout")


def bars_from_ticks(ticks: DataFrame, width: str = "1 day") -> DataFrame:
    """Tumbling open-high-low-close bars per symbol."""
    at = F.struct("ts", "id")
    bars = ticks.withWatermark("ts", "1 hour").groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.count(F.lit(1)).alias("n"))
    return bars.select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def deduplicated(ticks: DataFrame, key: list[str], delay: str = "40 days") -> DataFrame:
    """First arrival of each key within the watermark."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def hits_per_window(ticks: DataFrame, width: str = "6 hours", slide: str = "3 hours") -> DataFrame:
    """Sliding counts per symbol, for rate limits."""
    hits = ticks.withWatermark("ts", "1 hour").groupBy("symbol", F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return hits.select("symbol", F.col("w.start").alias("start"), "n")


def limited(hits: DataFrame, key: str, limit: int, window: float) -> DataFrame:
    """Admit at most ``limit`` hits per key in any ``window`` seconds; refused hits do not count.

    Adds ``admitted`` and ``retry`` (whole seconds until a refused hit could be admitted; NULL if admitted).  The state is the times
    of the admitted hits of the last window, ``limit`` at most.  Inside a micro-batch hits are taken in order of time and id.
    """
    kind = hits.schema[key].dataType.simpleString()

    def admit(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        recent = deque(state.get[0] if state.exists else [])
        admitted, retry = [], []
        for now in (rows["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist():
            while recent and recent[0] <= now - window:
                recent.popleft()
            free = len(recent) < limit
            admitted.append(free)
            retry.append(None if free else max(1, math.ceil(recent[0] + window - now)))
            if free:
                recent.append(now)
        state.update((list(recent),))
        yield pd.DataFrame({key: group[0], "id": rows["id"].to_numpy(), "admitted": admitted, "retry": pd.array(retry, dtype="Int64")})

    return hits.select(key, "id", "ts").groupBy(key).applyInPandasWithState(admit, f"{key} {kind}, id long, admitted boolean, retry long", "times array<double>", "append", "NoTimeout")


def sessions(ticks: DataFrame, gap: str = "2 hours") -> DataFrame:
    s = ticks.withWatermark("ts", "1 hour").groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def alerts_once(ticks: DataFrame, levels: DataFrame) -> DataFrame:
    """Alerts (symbol, level, direction) that fire at the first crossing and never again; the state is one flag per alert."""

    def fire(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        if not state.exists:
            first = rows.iloc[0]
            state.update((int(first["id"]),))
            yield pd.DataFrame({"symbol": [key[0]], "level": [key[1]], "direction": [key[2]], "price": [first["price"]], "id": [first["id"]]})

    # Spark broadcasts the levels if they are few, and shuffles both sides otherwise
    crossed = ticks.join(levels, "symbol").where(F.when(F.col("direction") == "above", F.col("price") >= F.col("level")).otherwise(F.col("price") <= F.col("level")))
    return crossed.select("symbol", "level", "direction", "price", "id", "ts").groupBy("symbol", "level", "direction").applyInPandasWithState(fire, "symbol string, level double, direction string, price double, id long", "fired long", "append", "NoTimeout")
