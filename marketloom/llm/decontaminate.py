"""Benchmark decontamination by winnowing.

Both sides are cut into lower-case words.  For a window of L words the fingerprint is the smallest hash of
its k-grams (k = min(5, L), rightmost on ties); L is 10, or the whole item if that is shorter.  Equal
windows have equal fingerprints at equal offsets, so joining a document's winnowed fingerprints with those of
the items finds every shared span of L words.  A hit carries the words around its k-gram and is extended to the
windows of the item that hold it; only windows that match word for word count.

A bit map of fixed size (2^23 bits, gathered from all items) keeps fingerprints that no item has
inside the scan; what is shuffled is the matches.  Hot passages are joined with Spark's skew handling, as
documents are only ever the streamed side.

Texts over PIECE bytes are scanned in pieces that overlap by OVERLAP words, so every window is whole in one of them.

Defined cases: null and wordless texts have no words and are clean; rows equal in id and text get the same
result; null item ids are left out of the lists but mark words; empty tables work on either side; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import PIECE, mixed, pieces, powers, slices
from .common import bit_map, in_bit_map, stored, text_or_empty

WINDOW, GRAM = 10, 5
OVERLAP = 2 * WINDOW
#: Lower-case A-Z; blanks for the other characters below 0x80 that are no letter or digit.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_IN_WORD, _IN_GRAM = powers(0x9E3779B97F4A7C15, 4096), powers(0xC2B2AE3D27D4EB4F, GRAM)
_NO_ID = -(2**63)


class Words:
    """Words of a batch of texts: their places in one buffer, hashes, and the range of each text."""

    def __init__(self, texts: list[bytes]):
        self.data = b" " + b" ".join(texts).translate(_TABLE) + b" "
        inside = np.frombuffer(self.data, dtype=np.uint8) != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        self.first = np.searchsorted(self.starts, begins)
        self.last = np.r_[self.first[1:], len(self.starts)] if len(texts) else self.first
        self.hashes = np.zeros(0, dtype=np.uint64)
        if len(self.starts):
            lengths = self.ends - self.starts
            heads = np.cumsum(lengths) - lengths
            place = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
            chars = np.frombuffer(self.data, dtype=np.uint8)[inside].astype(np.uint64)
            self.hashes = mixed(np.add.reduceat((chars + np.uint64(1)) * _IN_WORD[place & 4095], heads))

    def text(self, a: int, b: int) -> bytes:
        return b" ".join(self.data[s:e] for s, e in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist()))

    def winnow(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every window of ``length`` words inside a text: its start, its fingerprint, the k-gram's offset."""
        n, k = len(self.hashes), min(GRAM, length)
        if n < length:
            return (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int8))
        grams = mixed(sum((self.hashes[j : n - k + 1 + j] * _IN_GRAM[j] for j in range(k)), np.zeros(n - k + 1, dtype=np.uint64)))
        total = n - length + 1
        least, offset = grams[:total].copy(), np.zeros(total, dtype=np.int8)
        for j in range(1, length - k + 1):
            other = grams[j : j + total]
            lower = other <= least
            offset[lower] = j
            np.minimum(least, other, out=least)
        ends = np.repeat(self.last, self.last - self.first)[:total]
        start = np.flatnonzero(np.arange(total) + length <= ends)
        return start, least[start], offset[start]


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, length, h, off, words) for every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            words, ids = Words(texts), batch.column("item_id").to_pylist()
            sizes, rows = words.last - words.first, []
            for length in sorted(set(np.minimum(sizes, WINDOW).tolist()) - {0}):
                owner = np.searchsorted(words.first, np.arange(len(words.starts)), side="right") - 1
                for s, h, o in zip(*(x.tolist() for x in words.winnow(length))):
                    if min(int(sizes[owner[s]]), WINDOW) == length:
                        rows.append((ids[owner[s]], length, h - 2**64 if h >> 63 else h, o, words.text(s, s + length).decode()))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string()))], names=["item_id", "length", "h", "off", "words"])

    return items.select(F.col(id_col).cast("long").alias("item_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "item_id long, length int, h long, off int, words string")


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int, bool, list[bytes]]]:
    """(row, number of the first word, is it the end, texts): all texts at once, or the pieces of a long one, which overlap."""
    if max(map(len, texts), default=0) <= PIECE:
        yield 0, 0, True, texts
        return
    for row, text in enumerate(texts):
        base, parts = 0, list(pieces(text.translate(_TABLE), OVERLAP))
        for i, part in enumerate(parts):
            yield row, base, i + 1 == len(parts), [part]
            base += len(part.split()) - OVERLAP


def _scan(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """A row (length null) for each document, and a row for each of its fingerprints that the bit map lets through."""
    held = docs.sparkSession.sparkContext.broadcast(bits)  # 1 MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "n_words", "length", "h", "p", "skip", "ctx"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        for batch, texts in slices(batches):
            for at, base, ends, own in _parts(texts):
                yield from scanned(batch.slice(at, len(own)), own, base, ends)

    def scanned(batch: pa.RecordBatch, texts: list[bytes], base: int, ends: bool) -> Iterator[pa.RecordBatch]:
        """Rows of texts, or of one piece whose first word is word ``base`` of its text; the last piece counts the words."""
        names = ["doc_id", "th", "n_words", "length", "h", "p", "skip", "ctx"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        words, ids, ths = Words(texts), batch.column("doc_id"), batch.column("th")
        n, none = len(texts), lambda t, k: pa.nulls(k, t)
        if ends:
            yield pa.RecordBatch.from_arrays([ids, ths, pa.array(base + words.last - words.first), *[none(t, n) for t in types[3:]]], names=names)
        first, last = words.first, words.last
        for length in lengths:
            k = min(GRAM, length)
            start, h, off = words.winnow(length)
            found = np.flatnonzero(in_bit_map(held.value, h))
            at, pick = np.unique(start[found] + off[found], return_index=True)
            if not len(at):
                continue
            owner = np.searchsorted(first, at, side="right") - 1
            low = np.maximum(first[owner], at - (length - k))
            high = np.minimum(last[owner], at + length)
            ctx = [words.text(a, b).decode() for a, b in zip(low.tolist(), high.tolist())]
            own = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [ids.take(own), ths.take(own), none(pa.int64(), len(at)), pa.array(np.full(len(at), length, dtype=np.int32)), pa.array(h[found][pick].view(np.int64)), pa.array((at - first[owner] + base).astype(np.int32)), pa.array((at - low).astype(np.int32)), pa.array(ctx, pa.string())], names=names,
            )

    doc_id, th = row_key()
    rows = docs.select(doc_id.alias("doc_id"), th.alias("th"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, n_words long, length int, h long, p int, skip int, ctx string")


def row_key() -> list[Column]:
    """What tells documents apart: doc_id (null as the smallest long) and a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64(text_or_empty()).alias("_th")]


def contaminated_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(_id, _th): the row keys of the documents that share a window with an item."""
    return _hits(docs, items)[2].select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()


def _hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The items' windows, the documents' scan, and the documents' windows that match word for word."""
    windows = stored(item_windows(items), "bench-windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most WINDOW values
    scan = stored(_scan(docs, lengths, bit_map(windows, "h")), "bench-scan")
    key = ["doc_id", "th"]
    asked = windows.select("length", "h", "off", "words").distinct()
    hits = scan.where("length is not null").join(asked, ["length", "h"]).withColumn("s", F.col("p") - F.col("off")).withColumn("lead", F.col("skip") - F.col("off"))
    hits = hits.where("lead >= 0 and array_join(slice(split(ctx, ' '), lead + 1, length), ' ') = words").select(*key, "s", "length", "words").distinct()
    return windows, scan, stored(hits, "bench-hits")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows, scan, hits = _hits(docs, items)
    key = ["doc_id", "th"]
    order = Window.partitionBy(*key).orderBy("s", "length")
    reach = F.coalesce(F.max(F.col("s") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = hits.withColumn("_new", F.greatest(F.lit(0), F.col("s") + F.col("length") - F.greatest(F.col("s"), reach))).groupBy(*key).agg(F.sum("_new").alias("n_hit"))
    named = hits.select(*key, "words").distinct().join(windows.select("words", "item_id").distinct(), "words").select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    named = named.groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    marks = spans.join(named, key, "left")
    out = scan.where("length is null").select(*key, "n_words").join(marks, key, "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION_SQL = f"""
WITH b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT d.*, x.n, unnest(range(1, len(w) - x.n + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) x WHERE len(w) >= x.n)),
h AS (SELECT r, s, dw.n, item_id FROM dw JOIN bw USING (n, k)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
