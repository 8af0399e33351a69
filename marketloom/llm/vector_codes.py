"""Vector code compression: one codebook per part of the vectors, fitted by Lloyd's rounds with Elkan's bounds.

Components become the integers floor(1024 x) and all distances that decide are exact integers.  The first assignment compares every
part with every entry of its codebook.  From then on each row keeps, per part, an upper bound of the distance to its entry and one lower
bound per entry (a byte, in steps of the part's largest bound, rounded down).  Between rounds the upper bound grows by the movement of its
entry and the lower bounds shrink by theirs.  An entry is skipped only where a bound proves it strictly farther: its lower bound is above the
upper bound, or half its distance to the row's entry is.  All other distances are computed in integers, and ties go to the lower index, so that
the codes equal those of a plain search.  Where the bounds leave more than a quarter of a block open, the block is computed as one matrix product.

Rows with their bounds go through two folders of the shared directory in turn (Parquet, the older one is overwritten), so a lost executor
costs a task and no round; the driver holds codebooks and their sums only, parts * entries * part length numbers.  Sums are added up in tasks, then by Spark.

Defined cases: rows whose vector is null or holds a null, NaN, infinite or (its integer would not fit) 2^52 or larger component are dropped.  Vectors are
padded with zeros to the longest length, rounded up to whole parts.  Fewer rows than entries make a smaller codebook; no row gives an empty result.
The starting rows are the smallest by vec_id (nulls last), then vector; equal rows count as rows.  An error beyond a long is null, and so is the
``label_error`` of its label; null labels are one label.  Further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, shared_dir

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows that are worked on at once.
BLOCK = 2048
#: Share of open (row, entry) pairs above which a block is computed as a whole.
DENSE = 0.25
#: Relative slack that covers the rounding of square roots and of the stored bounds.
SLACK = 1e-6
STATE = "vec_id long, label string, x array<bigint>, code binary, upper binary, lower binary"


def integer_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as text), x: the kept rows with whole-number components."""
    fine = "embedding IS NOT NULL AND NOT exists(embedding, v -> v IS NULL OR isnan(v) OR abs(v) >= 4503599627370496D)"
    return vectors.where(fine).selectExpr("vec_id", "cast(label AS string) AS label", f"transform(embedding, v -> cast(floor({SCALE}D * v) AS bigint)) AS x")


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis: 64-bit where they fit, Python integers where not."""
    most = max((int(np.abs(v).max()) for v in (x, c) if v.size), default=0)
    if x.shape[-1] * (2 * most) ** 2 >= 2**62:
        x, c = x.astype(object), c.astype(object)
    diff = x - c
    return (diff * diff).sum(-1)


def to_all(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every entry."""
    most = max((int(np.abs(v).max()) for v in (x, c) if v.size), default=0)
    if x.shape[1] * (2 * most) ** 2 < 2**52:  # whole numbers that doubles hold
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None, :]).astype(np.int64)
    return np.concatenate([exact(x[i : i + 32, None, :], c[None]) for i in range(0, len(x), 32)])


def above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + SLACK)


def below(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - SLACK)


class Codebook:
    """Entries of one part position, how far they moved since the round before, and half of their distances from each other."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        self.moved = above(exact(entries, before)) if before is not None else None
        self.half = below(to_all(entries, entries)) / 2
        apart = self.half.copy()
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(1)


def first_assignment(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, upper bound and lower bounds of each row's part."""
    d = to_all(x, book.entries)
    at = d.argmin(1)
    return at, above(d[np.arange(len(x)), at]), below(d)


def reassignment(x: np.ndarray, book: Codebook, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries moved, and the number of distances that were computed."""
    upper = (upper + book.moved[at]) * (1 + SLACK)
    lower = np.maximum(lower * (1 - SLACK) - book.moved[None, :], 0)
    rows = np.flatnonzero(upper >= book.nearest[at])
    if not len(rows):
        return at, upper, lower, 0
    own = exact(x[rows], book.entries[at[rows]])
    limit = above(own)
    open_ = (lower[rows] <= limit[:, None]) & (book.half[at[rows]] <= limit[:, None])
    every = np.arange(len(rows))
    open_[every, at[rows]] = False
    if open_.mean() > DENSE:
        d, count = to_all(x[rows], book.entries), open_.size
        lower[rows] = below(d)
    else:
        i, j = np.nonzero(open_)
        found = [exact(x[rows[i[s : s + 65536]]], book.entries[j[s : s + 65536]]) for s in range(0, len(i), 65536)]
        found, count = (np.concatenate(found) if found else own[:0]), len(i) + len(rows)
        worst = max((int(v.max()) for v in (found, own) if len(v)), default=0) + 1
        d = np.full((len(rows), len(book.entries)), worst, dtype=object if worst >= 2**63 else np.int64)
        d[i, j], d[every, at[rows]] = found, own
        lower[rows[i], j], lower[rows, at[rows]] = below(found), below(own)
    at, upper = at.copy(), upper.copy()
    at[rows] = d.argmin(1)
    upper[rows] = above(d[every, at[rows]])
    return at, upper, lower, count


def packed(lower: np.ndarray) -> np.ndarray:
    """Lower bounds as a step (32-bit float) and one byte per entry, rounded down."""
    step = np.maximum(lower.max(1, initial=0) / 255, 1e-30).astype(np.float32)
    q = np.clip(np.floor(lower * (1 - SLACK) / step.astype(np.float64)[:, None]), 0, 255).astype(np.uint8)
    return np.concatenate([step[:, None].view(np.uint8), q], axis=1)


def unpacked(raw: np.ndarray) -> np.ndarray:
    return raw[:, 4:] * np.ascontiguousarray(raw[:, :4]).view(np.float32).astype(np.float64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The components as rows of ``width`` numbers, short rows padded with zeros."""
    values, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int64) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows.tobytes())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            yield batch.slice(i, BLOCK)


def _assigner(books: list[Codebook], width: int, first: bool, last: bool) -> Callable:
    size, k = width // len(books), len(books[0].entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            x = _matrix(block.column("x"), width)
            ats, uppers, lowers, errors = [], [], [], 0
            if not first:
                codes, bounds, raw = _bytes(block.column("code")), _bytes(block.column("upper")).view(np.float64), _bytes(block.column("lower"))
            for m, book in enumerate(books):
                part = x[:, m * size : (m + 1) * size]
                if first:
                    at, upper, lower = first_assignment(part, book)
                else:
                    at, upper, lower, _ = reassignment(part, book, codes[:, m].astype(np.int64), bounds[:, m], unpacked(raw[:, m * (k + 4) : (m + 1) * (k + 4)]))
                ats.append(at.astype(np.uint8))
                if last:
                    errors = errors + exact(part, book.entries[at]).astype(object)
                else:
                    uppers.append(upper)
                    lowers.append(packed(lower))
            out = [block.column("vec_id"), block.column("label")]
            if last:
                yield pa.RecordBatch.from_arrays([*out, _binary(np.stack(ats, 1)), pa.array([e if e < 2**63 else None for e in errors], pa.int64())], ["vec_id", "label", "code", "error"])
            else:
                out += [block.column("x"), _binary(np.stack(ats, 1)), _binary(np.stack(uppers, 1)), _binary(np.concatenate(lowers, 1))]
                yield pa.RecordBatch.from_arrays(out, ["vec_id", "label", "x", "code", "upper", "lower"])

    return run


def _summer(parts: int, k: int, width: int) -> Callable:
    """Counts and component sums per entry; a component is added up as two halves of 31 bits and more, so nothing overflows."""
    size = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = np.zeros((parts, k), np.int64), np.zeros((parts, k, size), np.int64), np.zeros((parts, k, size), np.int64)
        for block in _blocks(batches):
            x, codes = _matrix(block.column("x"), width), _bytes(block.column("code"))
            for m in range(parts):
                n[m] += np.bincount(codes[:, m], minlength=k)
                for i in range(size):
                    v = x[:, m * size + i]
                    high[m, :, i] += np.bincount(codes[:, m], weights=v >> 31, minlength=k).astype(np.int64)
                    low[m, :, i] += np.bincount(codes[:, m], weights=v & (2**31 - 1), minlength=k).astype(np.int64)
        part, entry, at = (v.ravel().astype(np.int32) for v in np.indices((parts, k, size)))
        used = np.repeat(n.ravel(), size)
        keep = used > 0
        yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for v in (part, entry, at, used, high.ravel(), low.ravel())], ["part", "entry", "at", "n", "high", "low"])

    return run


def _updated(state: DataFrame, books: list[Codebook], width: int) -> list[Codebook]:
    """Codebooks whose entries are the floors of their rows' means; unused entries stay."""
    sums = state.select("x", "code").mapInArrow(_summer(len(books), len(books[0].entries), width), "part int, entry int, at int, n long, high long, low long")
    sums = sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    entries = [b.entries.copy() for b in books]
    for r in sums.toLocalIterator():  # as many rows as the codebooks have numbers
        entries[r.part][r.entry, r.at] = (int(r.high) * 2**31 + int(r.low)) // r.n
    return [Codebook(e, b.entries) for e, b in zip(entries, books)]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code as bytes, error) of every kept row, and the final codebooks."""
    spark, home = vectors.sparkSession, f"{shared_dir(vectors.sparkSession)}/codes-{uuid.uuid4().hex}"
    state = integer_rows(vectors)
    if state.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        state = state.repartition(spark.sparkContext.defaultParallelism)
    state = _rewritten(state, f"{home}-rows")
    longest = state.agg(F.max(F.size("x"))).first()[0]
    width = -(-(longest or 0) // parts) * parts
    seeds = [r.x + [0] * (width - len(r.x)) for r in state.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    seeds = np.array(seeds, dtype=np.int64).reshape(len(seeds), width)
    if not len(seeds):
        return state.selectExpr("vec_id", "label", "cast('' AS binary) AS code", "0L AS error"), []
    books = [Codebook(c) for c in np.split(seeds, parts, axis=1)]
    for i in range(rounds + 1):
        last = i == rounds
        out = state.mapInArrow(_assigner(books, width, i == 0, last), "vec_id long, label string, code binary, error long" if last else STATE)
        state = _rewritten(out, f"{home}-{'final' if last else i % 2}")
        if not last:
            books = _updated(state, books, width)
    for name in ("rows", "0", "1"):  # the bounds are no longer needed
        spark.createDataFrame([], STATE).write.mode("overwrite").parquet(f"{home}-{name}")
    return state, [b.entries for b in books]


def _rewritten(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept row: vec_id, code, error, label_error, codebooks_sha256."""
    rows, books = compress(vectors, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel()).encode()).hexdigest()
    rows = rows.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce("label", F.lit(""))).withColumn("_spread", F.monotonically_increasing_id())
    total = F.expr("CASE WHEN count(error) = count(1) THEN try_cast(sum(cast(error AS decimal(19,0))) AS bigint) END")
    labels = rows.groupBy("_none", "_label").agg(total.alias("label_error"))
    out = salted_join(rows, labels, ["_none", "_label"], "_spread")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _rounds_sql() -> str:
    """The rounds, unrolled; squared distance and entry are compared as one number, so ties go to the lower entry."""
    steps = ["c0 AS (SELECT m, r AS j, i, v FROM comp WHERE r < 256)"]
    for t in range(ROUNDS + 1):
        far = f"SELECT r, m, c.j, sum((a.v - c.v) * (a.v - c.v)) AS d FROM comp a JOIN c{t} c USING (m, i) GROUP BY ALL"
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, m, min(d * 256 + j) AS best FROM ({far}) GROUP BY ALL)")
        if t < ROUNDS:
            mean = f"SELECT m, (best % 256)::BIGINT AS j, i, sum(v) AS s, count(*) AS n FROM a{t} JOIN comp USING (r, m) GROUP BY ALL"
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c.m, c.j, c.i, coalesce((s - ((s % n + n) % n)) // n, c.v)::BIGINT AS v FROM c{t} c LEFT JOIN ({mean}) u ON u.m = c.m AND u.j = c.j AND u.i = c.i)")
    return ",\n".join(steps)


CODES_SQL = f"""
WITH base AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS r, vec_id, label, x FROM (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)),
comp AS MATERIALIZED (SELECT r, pos // (n // {PARTS}) AS m, pos % (n // {PARTS}) AS i, v FROM (SELECT r, len(x) AS n, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS pos FROM base)),
{_rounds_sql()},
coded AS (SELECT r, string_agg(format('{{:02x}}', (best % 256)::BIGINT), '' ORDER BY m) AS code, sum(best // 256)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY m, j, i)) FROM c{ROUNDS}) AS codebooks_sha256
FROM base JOIN coded USING (r)
"""
