"""Document fingerprints by locally consistent parsing.

The bytes of a text are parsed bottom-up.  On each level runs of equal symbols become one symbol, deterministic
coin tossing (the lowest bit in which a symbol differs from its left neighbour, repeated until six colours
are left) colours the sequence, and phrases start at local maxima of colour.  A phrase's name is a hash of the
symbols in it, and names are the next level's symbols.  Where phrases start depends on a few neighbouring symbols
only, so equal substrings get equal interior names wherever they stand.

A fingerprint is the SKETCH smallest distinct names (32 bits each, as hex) of level BASE_LEVEL and the levels above it;
likeness is the share of common names among the SKETCH smallest of both.

``edited_likeness`` pairs each document with the next by id.  Documents are dealt into ranges of (id, text hash) once, at most
some RANGE_BYTES of text each, with the first document of each range copied into the range before it, so a range is
worked off as a stream and holds neither the table nor a group in memory.  Phrases are named PHRASES at a time, so a
long text takes some 12 bytes of memory a byte.

Defined cases: a null text is an empty one with an empty fingerprint (likeness 1 to another empty one, else 0); a null
``doc_id`` comes first; rows with equal ids follow the hash of their text; the last document's next is the first, a sole
document is its own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import SLICE_BYTES, mixed, powers
from .common import text_or_empty

SKETCH, BASE_LEVEL, TOP_LEVEL, PHRASES, RANGE_BYTES = 64, 2, 24, 1 << 18, 128 << 20
_LOW_BIT = np.array([0, *[(x & -x).bit_length() - 1 for x in range(1, 256)]], dtype=np.uint8)
_STEP = powers(0xD6E8FEB86659FD93, 64)
_BYTE_NAMES = mixed(np.arange(1, 257, dtype=np.uint64))


def _colours(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Six colours for a sequence without equal neighbours inside a text; ``first`` marks texts' first symbols."""
    if symbols.dtype == np.uint8:
        colour = symbols
    else:
        differ = symbols.copy()
        differ[1:] ^= symbols[:-1]
        low = np.bitwise_count((differ & -differ) - np.uint64(1)).astype(np.uint8)
        low[first] = 0
        colour = low * np.uint8(2) + (symbols >> low.astype(np.uint64) & np.uint64(1)).astype(np.uint8)
    for _ in range(4 if symbols.dtype == np.uint8 else 3):
        differ = colour.copy()
        differ[1:] ^= colour[:-1]
        low = _LOW_BIT[differ]
        low[first] = 0
        colour = low * np.uint8(2) + (colour >> low & np.uint8(1))
    return colour


def _parse(symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level, and where each (non-empty) text begins there."""
    new = np.ones(len(symbols), dtype=bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[begins] = True
    runs_at = runs = np.zeros(0, dtype=np.int64)
    if not new.all():  # runs of equal symbols become one symbol
        more = ~np.r_[new, True]
        starts, stops = np.flatnonzero(new & more[1:]), np.flatnonzero(more[:-1] & ~more[1:]) + 1
        place = np.cumsum(new, dtype=np.int32) - np.int32(1)
        runs_at, runs, begins = place[starts].astype(np.int64), stops - starts, place[begins].astype(np.int64)
        symbols = symbols[new]
        del place, more
    del new
    colour = _colours(symbols, begins)
    start = np.zeros(len(symbols), dtype=bool)
    if len(symbols) > 2:
        start[1:-1] = (colour[1:-1] > colour[:-2]) & (colour[1:-1] > colour[2:])
    follows = begins[1:] - 1  # a text's last symbol has no right neighbour, its first none to the left
    start[follows] = False
    start[begins] = True
    heads = np.flatnonzero(start)
    edges = np.r_[heads, len(symbols)]
    out = np.empty(len(heads), dtype=np.uint64)
    for a in range(0, len(heads), PHRASES):  # so many at once: what they need beside is 8 bytes a symbol several times over
        own = edges[a : a + PHRASES + 1]
        low, high = int(own[0]), int(own[-1])
        names = _BYTE_NAMES[symbols[low:high]] if symbols.dtype == np.uint8 else symbols[low:high].copy()
        x, y = np.searchsorted(runs_at, [low, high])
        at = runs_at[x:y] - low
        names[at] = mixed(names[at] + runs[x:y].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        sizes = np.diff(own)
        names *= _STEP[(np.arange(low, high) - np.repeat(own[:-1], sizes)) & 63]
        out[a : a + PHRASES] = mixed(np.add.reduceat(names, own[:-1] - low) + sizes.astype(np.uint64))
    return out, np.searchsorted(heads, begins)


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted sketch (uint32) of each text."""
    full = [i for i, t in enumerate(texts) if t]
    out = [np.zeros(0, dtype=np.uint32)] * len(texts)
    if not full:
        return out
    sizes = np.fromiter((len(texts[i]) for i in full), dtype=np.int64, count=len(full))
    symbols, begins = np.frombuffer(b"".join(texts[i] for i in full), dtype=np.uint8), np.cumsum(sizes) - sizes
    levels = []
    for level in range(1, TOP_LEVEL + 1):
        symbols, begins = _parse(symbols, begins)
        if level >= BASE_LEVEL:  # every text goes that far, however short, so that its names do not depend on its neighbours
            levels.append((symbols.astype(np.uint32), [*begins.tolist(), len(symbols)]))
            if len(symbols) == len(begins):
                break
    for k, i in enumerate(full):
        parts = [names[b[k] : b[k + 1]] for names, b in levels]
        depth = next((d for d, p in enumerate(parts) if len(p) == 1), len(parts) - 1)
        out[i] = np.unique(np.concatenate(parts[: depth + 1]))[:SKETCH]
    return out


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    union = both[np.r_[True, ~twice]][:SKETCH]
    return float(np.count_nonzero(both[1:][twice] <= union[-1]) / len(union))


def _order_keys(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Byte strings that sort as (id, hash) do."""
    pairs = np.stack([ids.astype(np.int64), hashes.astype(np.int64)], axis=1).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(pairs.astype(">u8")).view("S16").ravel()


def edited_likeness(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    none = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(none)).alias("doc_id"), text_or_empty().alias("text")).withColumn("th", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ordered = rows.select("doc_id", "th").repartitionByRange(ranges, "doc_id", "th")
    lows = ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "th")).alias("low")).select("low.*").toArrow()  # a row per range
    bounds = np.sort(_order_keys(lows.column("doc_id").to_numpy(), lows.column("th").to_numpy()))
    last = max(1, len(bounds))

    @F.pandas_udf("int")
    def placed(ids: pd.Series, hashes: pd.Series) -> pd.Series:  # twice the range's number, plus one for a range's first row
        keys = _order_keys(ids.to_numpy(), hashes.to_numpy())
        right = np.searchsorted(bounds, keys, side="right")
        return pd.Series((2 * right + (np.searchsorted(bounds, keys, side="left") != right)).astype(np.int32))

    coded = rows.withColumn("code", placed("doc_id", "th"))
    own = coded.select(F.expr("code div 2 - 1").cast("int").alias("part"), F.lit(0).alias("tail"), "doc_id", "th", "text")
    heads = coded.where("code % 2 = 1").dropDuplicates(["code"])  # one of the rows that begin a range
    heads = heads.select(F.pmod(F.expr("code div 2 - 2"), F.lit(last)).cast("int").alias("part"), F.lit(1).alias("tail"), "doc_id", "th", "text")
    dealt = own.unionByName(heads).repartitionById(last, "part").sortWithinPartitions("part", "tail", "doc_id", "th").select("part", "tail", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            pairs = [(a, b) for a, b in zip(held, held[1:]) if not a[1]]
            whole = dict(zip(map(id, held), sketches([r[3].encode() for r in held])))
            edited = [a[3][: len(a[3]) - len(a[3]) // 4] + b[3][: len(a[3]) // 4] for a, b in pairs]
            marks = sketches([e.encode() for e in edited])
            own, following = [whole[id(a)] for a, _ in pairs], [whole[id(b)] for _, b in pairs]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([None if a[2] == none else a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array(map(text_of, own), pa.string()), pa.array(map(text_of, marks), pa.string()), pa.array(map(likeness, own, marks), pa.float64()), pa.array(map(likeness, own, following), pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns)):
                    held.append(row)
                    size += len(row[3])
                    if size >= SLICE_BYTES:
                        yield done()
                        held, size = [held[-1]], len(row[3])
        if len(held) > 1:
            yield done()

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
