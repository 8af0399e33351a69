"""File sources and sinks: tolerant readers, keyed tables on Parquet, backups.

There is no transactional table format here, so a keyed table is a Parquet folder whose writer puts what has changed beside
the old files, and readers take the newest complete manifest; an executor lost in mid-write leaves the old version readable.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share (``spark.checkpoint.dir``; a temporary folder where that is unset and Spark is local)."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="marketloom-")
        context.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], header: bool = True, sep: str = ",") -> DataFrame:
    """Columns by name with tolerant casts: what does not parse is NULL.  ``columns`` maps names to types, in file order without a header.

    Without a header a first line of names is dropped: it has no number where the first numeric column should be.
    """
    text = spark.read.csv(path, header=header, sep=sep, schema=None if header else ", ".join(f"`{c}` string" for c in columns))
    out = text.select(*[F.expr(f"try_cast(`{c}` as {t})").alias(c) for c, t in columns.items()])
    number = next((c for c, t in columns.items() if t in ("double", "bigint", "int")), None)
    return out if header or number is None else out.where(F.col(number).isNotNull())


def read_json_records(spark: SparkSession, path: str, field: str, schema: str, multi_line: bool = False) -> DataFrame:
    """One row per element of the array ``field`` of JSON documents, one per line or (``multi_line``) one per file."""
    docs = spark.read.json(path, schema=f"`{field}` array<struct<{schema}>>", multiLine=multi_line)
    return docs.select(F.explode(field).alias("_r")).select("_r.*")


def epoch_day(c: Column, unit: str = "ms") -> Column:
    return F.to_date(F.timestamp_millis(c) if unit == "ms" else F.timestamp_seconds(c))


def cell(part: str, bucket: int) -> str:
    return f"{part}|{bucket}"


class KeyedTable:
    """Rows unique by key in versioned Parquet folders, dealt into cells: a part (such as the day, given by the key) and a bucket of the key's hash.

    A version is a folder ``v=<number>`` under ``path``: the rows of the cells it has changed, and a manifest that names for every cell
    the version that holds it.  Only a version with the writer's success marker counts, and the highest counts.  Any object over the same path, in
    any session, finds it; a reader reads one manifest.  A change rewrites the cells that its keys fall into and nothing else; a table whose cells lie in
    more than ``versions`` versions also rewrites those of the version with the fewest, and folders that neither the newest nor the manifest
    before it names are removed.  One writer at a time; a reader may be one version behind.

    A batch of a stream is recorded in the manifest of the version that it makes, so that a batch that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 16, part: Column | None = None, versions: int = 8):
        self.spark, self.path, self.keys, self.schema, self.buckets, self.versions = spark, path, keys, schema, buckets, versions
        self.part = F.lit("all") if part is None else F.coalesce(part.cast("string"), F.lit("none"))

    def _file(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _folders(self) -> list[int]:
        root, store = self._file()
        names = [f.getPath().getName() for f in store.listStatus(root)] if store.exists(root) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def _versions(self) -> list[int]:
        """Complete versions, oldest first."""
        return [v for v in self._folders() if (lambda f: f[1].exists(f[0]))(self._file(f"v={v}/_SUCCESS"))]

    def _manifest(self, version: int) -> tuple[dict[tuple[str, int], int], dict[str, int]]:
        """The version of every cell (as many rows as the table has cells), and the last batch of every stream."""
        rows = self.spark.read.schema("part string, bucket int, v int, stream string, batch long").json(f"{self.path}/v={version}/manifest").collect()
        return {(r.part, r.bucket): r.v for r in rows if r.stream is None}, {r.stream: r.batch for r in rows if r.stream is not None}

    def _celled(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"_part": self.part, "_bucket": F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")})

    def _state(self) -> tuple[int, dict[tuple[str, int], int], dict[str, int]]:
        versions = self._versions()
        return (versions[-1], *self._manifest(versions[-1])) if versions else (0, {}, {})

    def _rows(self, cells: dict[tuple[str, int], int]) -> DataFrame:
        """Rows with their cell; a filter on the folders' names alone, so other cells are not opened."""
        out = self._celled(self.spark.createDataFrame([], self.schema))
        for v in sorted(set(cells.values())):
            own = [cell(*c) for c, at in cells.items() if at == v]
            rows = self.spark.read.schema(out.schema).parquet(f"{self.path}/v={v}/rows")
            out = out.unionByName(rows.where(F.concat_ws("|", "_part", F.col("_bucket").cast("string")).isin(own)))
        return out

    def read(self) -> DataFrame:
        return self._rows(self._state()[1]).drop("_part", "_bucket")

    def last_batch(self, stream: str) -> int | None:
        return self._state()[2].get(stream)

    def _write(self, rows: DataFrame, touched: set[tuple[str, int]], state: tuple, batch: tuple[str, int] | None = None) -> None:
        """A new version with the rows of the touched cells; the marker comes last."""
        _, cells, streams = state
        new = max([0, *self._folders()]) + 1
        rest = {c: v for c, v in cells.items() if c not in touched}
        held = [v for v in set(rest.values())]
        if len(held) >= self.versions:  # fold the version with the fewest cells into this one
            least = min(held, key=lambda v: (sum(x == v for x in rest.values()), v))
            folded = {c: v for c, v in rest.items() if v == least}
            rows, touched = rows.unionByName(self._rows(folded)), touched | set(folded)
            rest = {c: v for c, v in rest.items() if v != least}
        rows.repartition("_part", "_bucket").write.mode("overwrite").partitionBy("_part", "_bucket").parquet(f"{self.path}/v={new}/rows")
        streams = streams | ({batch[0]: batch[1]} if batch else {})
        names = [(p, b, v, None, None) for (p, b), v in (rest | {c: new for c in touched}).items()] + [(None, None, None, s, n) for s, n in streams.items()]
        self.spark.createDataFrame(names, "part string, bucket int, v int, stream string, batch long").coalesce(1).write.mode("overwrite").json(f"{self.path}/v={new}/manifest")
        done, store = self._file(f"v={new}/_SUCCESS")
        store.create(done, True).close()
        self._clean(set(rest.values()) | {new} | set(cells.values()) | {state[0]})

    def _clean(self, used: set[int]) -> None:
        for v in self._versions():
            if v not in used:
                old, store = self._file(f"v={v}")
                store.delete(old, True)

    def _touched(self, rows: DataFrame) -> set[tuple[str, int]]:
        return {(r[0], r[1]) for r in rows.select("_part", "_bucket").distinct().collect()}

    def _merge(self, rows: DataFrame, order: list[Column], batch: tuple[str, int] | None) -> bool:
        state = self._state()
        if batch is not None and state[2].get(batch[0], -1) >= batch[1]:
            return False
        rows = self._celled(rows)
        touched = self._touched(rows)
        if touched:
            old = self._rows({c: v for c, v in state[1].items() if c in touched}).withColumn("_new", F.lit(0))
            n = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order))
            merged = old.unionByName(rows.withColumn("_new", F.lit(1))).withColumn("_n", n).where("_n = 1").drop("_n", "_new")
            self._write(merged, touched, state, batch)
        return bool(touched)

    def upsert(self, rows: DataFrame, order: list[Column], batch: tuple[str, int] | None = None) -> bool:
        """New rows replace old ones of their key; among the new the first in ``order`` wins.

        ``batch``: the stream's name and the number of its batch; one that is not above the stream's last changes nothing.  Tells whether rows were written.
        """
        return self._merge(rows, [F.desc("_new"), *order], batch)

    def insert_ignore(self, rows: DataFrame, order: list[Column], batch: tuple[str, int] | None = None) -> bool:
        """The first writer of a key wins."""
        return self._merge(rows, [F.col("_new"), *order], batch)

    def prune(self, keep: Column) -> None:
        """Keep what ``keep`` holds for; cells without other rows are left alone."""
        state = self._state()
        touched = self._touched(self._rows(state[1]).where(~F.coalesce(keep, F.lit(False))))
        if touched:
            self._write(self._rows({c: v for c, v in state[1].items() if c in touched}).where(keep), touched, state)

    def prune_older(self, column: str, today: Column, keep_days: int) -> None:
        """Drop rows older than ``keep_days`` before ``today``; with 0 or fewer days nothing is dropped."""
        if keep_days > 0:
            self.prune(F.col(column) >= F.date_sub(today, keep_days))

    def vacuum(self) -> None:
        """Write all cells as one version and remove the older ones (not while others read them)."""
        state = self._state()
        self._write(self._rows(state[1]), set(state[1]), state)
        self._clean({self._versions()[-1]})


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a log folder; readers see whole files only."""
    rows.write.mode("append").parquet(path)


def copy_since(source: DataFrame, target: KeyedTable, time: str, since: str, order: list[Column], apply: bool = False) -> DataFrame:
    """Rows per symbol from the date on; they are upserted into the target only if ``apply`` is set (otherwise a dry run)."""
    rows = source.where(F.col(time) >= F.lit(since).cast("date"))
    if apply:
        target.upsert(rows, order)
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def backup(df: DataFrame, path: str) -> None:
    """Gzipped JSON lines; decimals and dates as text."""
    plain = df.select(*[F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() in ("decimal", "date", "timestamp") else F.col(f.name) for f in df.schema])
    plain.write.json(path, compression="gzip")


def restore(spark: SparkSession, path: str, schema) -> DataFrame:
    texts = ", ".join(f"`{f.name}` {'string' if f.dataType.typeName() in ('decimal', 'date', 'timestamp') else f.dataType.simpleString()}" for f in schema)
    return spark.read.json(path, schema=texts).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
