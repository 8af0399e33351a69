"""Bounded batches of text inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text still goes whole.
SLICE_BYTES = 2 << 20
#: Longer texts are worked off in pieces of about so many bytes.
PIECE = 1 << 20
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut record batches into parts of about ``limit`` bytes of text, with the texts as UTF-8 bytes."""
    for batch in batches:
        text = batch.column(column)
        lengths = np.asarray(pc.binary_length(text).fill_null(0)).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lengths)] if len(lengths) else []
        for a, b in zip(edges, edges[1:]):  # only this part's texts become Python objects
            yield batch.slice(a, b - a), text.slice(a, b - a).cast(pa.binary()).fill_null(b"").to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def pieces(text: bytes, overlap: int, limit: int = PIECE) -> Iterator[bytes]:
    """Cut a long text between words; each piece begins with the last ``overlap`` words of the one before and has more words than that."""
    at = 0
    while len(text) - at > limit:
        end, words = at, []
        while end < len(text) and len(words) <= overlap:
            blank = _BLANK.search(text, min(len(text), end + limit))
            end = blank.start() if blank else len(text)
            words = text[at:end].rsplit(None, overlap)
        if end == len(text):
            break
        yield text[at:end]
        at = at + len(words[0]) if overlap else end
    yield text[at:]
