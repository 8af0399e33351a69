"""Keyword tables: which keyword of a large table, first by priority, stands in a text.

The table becomes one automaton that finds all keywords in one pass over a text, however many there are; every Python worker builds it
once.  A table of more than ``part_bytes`` is dealt into several automata, which read the texts one after the other and keep the better match, so the
memory of a worker is bounded and no keyword is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch

PART_BYTES = 16 << 20
_BUILT: dict[str, tuple[ahocorasick.Automaton, list]] = {}


def _automaton(name: str, rows: list[tuple[int, str, str]]) -> tuple[ahocorasick.Automaton, list]:
    if name not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton()
        for rank, (_, keyword, _) in enumerate(rows):
            if keyword not in found:  # rows come in order of priority
                found.add_word(keyword, rank)
        if rows:
            found.make_automaton()
        _BUILT[name] = found, rows
    return _BUILT[name]


def best_match(automaton: ahocorasick.Automaton, text: str) -> int | None:
    """The smallest rank among all keywords in the text."""
    best = None
    for _, rank in automaton.iter(text):
        if best is None or rank < best:
            if rank == 0:
                return 0
            best = rank
    return best


def _scanner(name: str, held, keys: list[str], keep_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, rows = _automaton(name, held.value)
        for batch in batches:
            out: list[tuple] = []
            before = zip(*[batch.column(c).to_pylist() for c in ("_priority", "_keyword", "_symbol")])
            for text, old in zip(batch.column("_lower").to_pylist(), before):
                rank = best_match(automaton, text) if text and rows else None
                new = rows[rank] if rank is not None else None
                out.append(old if new is None or old[0] is not None and old <= new else new)
            columns = [batch.column(c) for c in [*keys, *(["_lower"] if keep_text else [])]]
            found = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, *found], [*keys, *(["_lower"] if keep_text else []), "_priority", "_keyword", "_symbol"])

    return run


def first_keyword(texts: DataFrame, keywords: DataFrame, keys: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """``keys`` of every row of ``texts`` (with ``text``), and the symbol and keyword of its first match (null if it has none).

    ``keywords``: keyword, symbol, priority (whole numbers, smallest first).  Letters match in either case.  Of equal priorities the smaller
    keyword wins, then the smaller symbol.  Null and empty keywords and null symbols or priorities match nothing; a null text holds nothing.
    """
    spark = texts.sparkSession
    table = keywords.select(F.col("priority").cast("long").alias("priority"), F.lower("keyword").alias("keyword"), F.col("symbol").cast("string").alias("symbol"))
    table = table.where("priority IS NOT NULL AND keyword <> '' AND symbol IS NOT NULL").distinct()
    size = table.agg(F.coalesce(F.sum(F.octet_length("keyword") + 16), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    nothing = [F.lit(None).cast(t).alias(c) for t, c in (("long", "_priority"), ("string", "_keyword"), ("string", "_symbol"))]
    rows = texts.select(*keys, F.lower("text").alias("_lower"), *nothing)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    for part in range(parts):
        own = table.where(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == part).orderBy("priority", "keyword", "symbol")
        held = spark.sparkContext.broadcast([tuple(r) for r in own.toLocalIterator()])  # about part_bytes
        last = part == parts - 1
        names = [*keys, *([] if last else ["_lower"]), "_priority", "_keyword", "_symbol"]
        rows = rows.mapInArrow(_scanner(uuid.uuid4().hex, held, keys, not last), ", ".join(f"`{c}` {kinds[c]}" for c in names))
        if not last:  # so that two automata are never in memory together
            path = scratch(spark, "keywords")
            rows.write.parquet(path)
            rows = spark.read.parquet(path)
    return rows.select(*keys, F.col("_symbol").alias("symbol"), F.col("_keyword").alias("keyword"))
