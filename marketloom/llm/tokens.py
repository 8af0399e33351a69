"""Exact token counts by prefix dynamic programming over byte-pair encodings.

A text is cut into pieces by the vocabulary's pattern.  For a piece, ``last[i]`` is the last token of the encoding of
its first i bytes: the one token t that ends there and that the encoder would leave standing after
``last[i - len(t)]``; the count is ``count[i - len(t)] + 1``.  So every prefix of every piece has its exact count, and
with running sums over the pieces every prefix of the text has: where to truncate for a token budget, or what a prefix costs,
is looked up and never re-encoded.

The recurrence runs for all distinct new pieces of like lengths at once, column by column in NumPy (of some CELLS bytes together; a
few long pieces go one by one, cut into segments that are columns in turn); a task keeps
the counts of at most CACHE_PIECES pieces.  Nothing is shuffled.

Prefixes are counted where they end between code points, not inside a special string or a contraction, and not inside a
run of blanks that the pattern cuts in two; ``cut_bytes`` is the longest such prefix within the limit.

Defined cases: null and empty texts have no tokens; equal rows get equal results; an empty table gives an empty result; a text
of any length goes whole; further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import SLICE_BYTES, mixed, powers, slices
from .common import text_or_empty

LIMIT, CACHE_PIECES, CELLS, FEW = 512, 300_000, 4_000_000, 16
#: Of a long piece: places worked on at once, places in a segment, and how many places early a segment is begun.
PLACES, SEGMENT, LEAD, SIEVE_BITS = 1 << 19, 512, 512, 22
#: The byte-level vocabulary's piece pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_BASE = powers(0x9E3779B97F4A7C15, 512)
_CONTRACTIONS = ("'re", "'ve", "'ll")


class Table:
    """A static map from 64-bit keys to small integers (-1 if absent), for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 18):
        self.bits, self.levels = bits, []
        while len(keys):  # what collides on one level goes to the next
            slot = self._slot(keys, len(self.levels))
            _, first = np.unique(slot, return_index=True)
            held, number = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32)
            held[slot[first]], number[slot[first]] = keys[first], values[first]
            self.levels.append((held, number))
            rest = np.ones(len(keys), dtype=bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        return (mixed(keys + np.uint64(level)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int32)
        for level, (held, number) in enumerate(self.levels):
            slot = self._slot(keys, level)
            out = np.where(held[slot] == keys, np.maximum(out, number[slot]), out)
        return out


def _unicode_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Counts of all prefixes for one tokenizer file (byte-level BPE whose ids follow the order of its merges)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _unicode_bytes()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pieces = regex.compile(PATTERN).findall
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        names = sorted(vocab, key=vocab.get)
        raw = [bytes(letters[c] for c in name) for name in names]
        self.left, self.right = np.arange(len(raw), dtype=np.int64), np.arange(len(raw), dtype=np.int64)
        for i, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            token = vocab[a + b]
            if token != 256 + i:
                raise ValueError("token ids must follow the order of the merges")
            self.left[token], self.right[token] = vocab[a], vocab[b]
        merged = np.arange(256, len(raw))
        self.pairs = Table(self._pair(self.left[merged], self.right[merged]), merged.astype(np.int32))
        own = np.ones(len(raw), dtype=bool)  # tokens that their own bytes encode to
        own[merged] = self.stands(self.left[merged], self.right[merged], merged)
        own &= own[self.left] & own[self.right]
        sizes = np.array([len(r) for r in raw])
        keys = np.array([int(np.sum((np.frombuffer(r, np.uint8).astype(np.uint64) + np.uint64(1)) * _BASE[: len(r)][::-1], dtype=np.uint64)) for r in raw], dtype=np.uint64)
        self.tokens, self.longest = Table(keys[own], np.flatnonzero(own).astype(np.int32)), int(sizes.max())
        self.lengths, self.sizes = sorted(set(sizes[own].tolist()), reverse=True), sizes
        self.sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)  # most places end no token of a given length
        self.sieve[self._sieved(keys[own])] = True
        self.reset()

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)

    def reset(self) -> None:
        self.ids: dict[str, int] = _Ids()
        self.names: list[str] = []
        self.counts = np.zeros(0, dtype=np.int32)  # of the first bytes of each piece, from 1 byte on
        self.starts = np.zeros(1, dtype=np.int64)

    def stands(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Does the encoder leave tokens a, b side by side (with no merge before ``limit`` across their border)?"""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 2**31, dtype=np.int64) if limit is None else limit.astype(np.int64)
        out, live = np.zeros(len(a), dtype=bool), np.arange(len(a))
        while len(live):  # undo the younger of the two tokens next to the border, look for an older merge across it
            across = self.pairs.get(self._pair(a, b))
            go = (across < 0) | (across >= limit)
            a, b, live = a[go], b[go], live[go]
            inner_a, inner_b, turn = self.right[a], self.left[b], a > b
            undo_a = np.where(turn, inner_a != a, inner_b == b)
            ended = (inner_a == a) & (inner_b == b)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, inner_a, a), np.where(undo_a, b, inner_b)
            out[live[ended]] = True
            a, b, limit, live = a[~ended], b[~ended], limit[~ended], live[~ended]
        return out

    def _columns(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Counts of the prefixes of pieces, longest piece first."""
        sizes = np.array([len(p) for p in pieces])
        width, n = int(sizes[0]), len(pieces)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width).astype(np.uint64) + np.uint64(1)
        hashes = np.zeros((n, width + 1), dtype=np.uint64)
        for i in range(width):
            hashes[:, i + 1] = hashes[:, i] * _BASE[1] + data[:, i]
        last, count = np.full((n, width + 1), -1, dtype=np.int32), np.zeros((n, width + 1), dtype=np.int32)
        for i in range(1, width + 1):
            rows = np.arange(np.searchsorted(-sizes, -i, side="right"))
            for size in self.lengths:
                if size > i or not len(rows):
                    continue
                token = self.tokens.get(hashes[rows, i] - hashes[rows, i - size] * _BASE[size])
                maybe = np.flatnonzero(token >= 0)
                if not len(maybe):
                    continue
                if size < i:
                    maybe = maybe[self.stands(last[rows[maybe], i - size], token[maybe])]
                found = rows[maybe]
                last[found, i], count[found, i] = token[maybe], count[found, i - size] + 1
                rows = np.delete(rows, maybe)
        return [count[k, 1 : s + 1] for k, s in enumerate(sizes)]

    def _ending(self, codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Tokens by length (longest first) and by the place in lo + 1 ... hi where they end; -1 where there is none."""
        first = max(0, lo - self.longest)
        grown, shrunk = powers(int(_BASE[1]), hi - first + 1), powers(pow(int(_BASE[1]), -1, 1 << 64), hi - first + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[first:hi] * shrunk[:-1], dtype=np.uint64)])
        out = np.full((len(self.lengths), hi - lo), -1, dtype=np.int32)
        for row, size in enumerate(self.lengths):
            ends = np.arange(max(lo + 1, first + size), hi + 1) - first
            keys = (sums[ends] - sums[ends - size]) * grown[ends - 1]
            maybe = np.flatnonzero(self.sieve[self._sieved(keys)])
            out[row, ends[maybe] + first - lo - 1] = self.tokens.get(keys[maybe])
        return out

    @staticmethod
    def _sieved(keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)

    def _walk(self, ending: np.ndarray, base: int, last: np.ndarray, lo: int, hi: int) -> None:
        """``last`` of the places lo + 1 ... hi one after the other; ``ending`` begins at place base + 1."""
        at, row = np.nonzero(ending[:, lo - base : hi - base].T >= 0)
        tokens = ending[row, at + lo - base].tolist()
        known: dict[tuple[int, int], bool] = {}
        recent = last[max(0, lo - self.longest) : lo + 1].tolist()
        shift, done = max(0, lo - self.longest), 0
        for i, row, token in zip((at + lo + 1).tolist(), row.tolist(), tokens):
            if i == done:
                continue
            size = self.lengths[row]
            if size < i:
                pair = (recent[i - size - shift], token)
                if pair not in known:
                    known[pair] = bool(self.stands(np.array([pair[0]]), np.array([token]))[0])
                if not known[pair]:
                    continue
            recent.append(token)
            done = i
        last[lo + 1 : hi + 1] = recent[lo + 1 - shift :]

    def _segments(self, ending: np.ndarray, base: int, last: np.ndarray, lo: int, hi: int) -> None:
        """The same, all segments of the range side by side.

        A segment is begun LEAD places early as if the piece began there.  Where it agrees with the segment before on as many places as the
        longest token has bytes, all that follows agrees too, since ``last`` depends on no earlier place; where not, it is walked through.
        """
        starts = np.arange(lo, hi, SEGMENT)
        begin, end = np.maximum(base, starts - LEAD), np.minimum(starts + SEGMENT, hi)
        own = np.full((len(starts), LEAD + SEGMENT + 1), -1, dtype=np.int32)
        for j in range(1, LEAD + SEGMENT + 1):
            rows = np.flatnonzero(begin + j <= end)
            here = ending[:, begin[rows] + j - base - 1]
            for k in np.flatnonzero((here >= 0).any(1)).tolist():
                size = self.lengths[k]
                if size > j:
                    continue
                maybe = np.flatnonzero(here[k] >= 0)
                if size < j and len(maybe):
                    maybe = maybe[self.stands(own[rows[maybe], j - size], here[k, maybe])]
                if len(maybe):
                    own[rows[maybe], j] = here[k, maybe]
                    here[:, maybe] = -1
        for k, (s, b, e) in enumerate(zip(starts.tolist(), begin.tolist(), end.tolist())):
            back = min(self.longest, s - b)
            if b == 0 or back == self.longest and (last[s - back + 1 : s + 1] == own[k, s - b - back + 1 : s - b + 1]).all():
                last[s + 1 : e + 1] = own[k, s - b + 1 : e - b + 1]
            else:
                self._walk(ending, base, last, s, e)

    def _long(self, piece: bytes) -> np.ndarray:
        """The same recurrence for one long piece, PLACES at once: first all tokens that end at each place, then which of them stand."""
        n = len(piece)
        codes = np.frombuffer(piece, np.uint8).astype(np.uint64) + np.uint64(1)
        last, count = np.full(n + 1, -1, dtype=np.int32), np.zeros(n + 1, dtype=np.int32)
        for lo in range(0, n, PLACES):
            hi, base = min(n, lo + PLACES), max(0, lo - LEAD)
            (self._segments if hi - lo >= 8 * SEGMENT else self._walk)(self._ending(codes, base, hi), base, last, lo, hi)
            before = np.arange(lo + 1, hi + 1) - self.sizes[last[lo + 1 : hi + 1]]
            steps = np.ones(hi - lo, dtype=np.int32)
            while (inside := before > lo).any():  # tokens back to this range's begin, by doubling
                to = before[inside] - lo - 1
                more, further = steps[to], before[to]
                steps[inside] += more
                before[inside] = further
            count[lo + 1 : hi + 1] = steps + count[before]
        return count[1:]

    def learn(self) -> None:
        """Work out the counts of the pieces that have joined ``ids`` since the last call."""
        self.names += islice(self.ids, len(self.names), None)
        new = [p.encode() for p in self.names[len(self.starts) - 1 :]]
        if not new:
            return
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(new)
        order = sorted(range(len(new)), key=lambda k: -len(new[k]))
        at = 0
        while at < len(order):  # groups whose widths are alike
            width = len(new[order[at]])
            group = [k for k in order[at : at + max(1, CELLS // width)] if 2 * len(new[k]) >= width or width <= 8]
            for k, counts in zip(group, self._columns([new[k] for k in group]) if width <= 64 or len(group) >= FEW else map(self._long, [new[k] for k in group])):
                out[k] = counts
            at += len(group)
        self.counts = np.concatenate([self.counts, *out])
        self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum([len(p) for p in new])]

    def cut(self, text: str) -> list[np.ndarray]:
        """Ids of the pieces of each part of the text between special strings."""
        parts = self.specials.split(text) if self.specials else [text]
        return [np.array(list(map(self.ids.__getitem__, self.pieces(part))), dtype=np.int64) for part in parts]

    def total(self, parts: list[np.ndarray]) -> int:
        """Tokens of a text that ``cut`` has cut and ``learn`` has seen."""
        return len(parts) - 1 + sum(int(self.counts[self.starts[p + 1] - 1].sum()) for p in parts)

    def _ends(self, piece: int, before: int | None) -> np.ndarray:
        """Byte lengths at which a prefix may end inside or after a piece that follows piece ``before``."""
        name = self.names[piece]
        ends, fine = np.cumsum([len(c.encode()) for c in name]), np.ones(len(name), dtype=bool)
        if name in _CONTRACTIONS:
            fine[1] = False
        if before is not None and self.names[before].isspace():  # blanks that go on from there are one piece if cut off here
            fine[: len(name) - len(name.lstrip())] = False
        return ends[fine]

    def _own(self, piece: int) -> np.ndarray:
        return self.counts[self.starts[piece] : self.starts[piece + 1]]

    def cut_at(self, text: str, parts: list[np.ndarray], limit: int) -> int:
        """Byte length of the longest countable prefix with at most ``limit`` tokens, of a text with more."""
        at, budget = 0, limit
        specials = [m.group() for m in self.specials.finditer(text)] if len(parts) > 1 else []
        for part, special in zip(parts, [*specials, ""]):
            sums = np.cumsum(self.counts[self.starts[part + 1] - 1])
            if len(sums) and sums[-1] > budget:
                sizes = self.starts[part + 1] - self.starts[part]
                for q in range(int(np.argmax(sums > budget)), -1, -1):
                    ends = self._ends(part[q], part[q - 1] if q else None)
                    ends = ends[self._own(part[q])[ends - 1] + (sums[q - 1] if q else 0) <= budget]
                    if len(ends):
                        return at + int(sizes[:q].sum() + ends[-1])
                return at
            at, budget = at + int((self.starts[part + 1] - self.starts[part]).sum()), budget - (int(sums[-1]) if len(sums) else 0)
            if budget < 1:
                return at
            at, budget = at + len(special.encode()), budget - 1
        return at

    def prefixes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Byte lengths of all countable prefixes of the text, ascending, and their exact token counts."""
        parts, at, used = self.cut(text), 0, 0
        self.learn()
        lengths, counts = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
        specials = [m.group() for m in self.specials.finditer(text)] if len(parts) > 1 else []
        for part, special in zip(parts, [*specials, ""]):
            for before, p in zip([None, *part[:-1].tolist()], part.tolist()):
                ends, own = self._ends(p, before), self._own(p)
                lengths.append(at + ends)
                counts.append(used + own[ends - 1].astype(np.int64))
                at, used = at + len(own), used + int(own[-1])
            if special:
                at, used = at + len(special.encode()), used + 1
                lengths.append(np.array([at]))
                counts.append(np.array([used]))
        return np.concatenate(lengths), np.concatenate(counts)


class _Ids(dict):
    """Numbers pieces as they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


_COUNTERS: dict[str, PrefixCounter] = {}


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, cut_bytes.

    ``tokenizer`` is the path of the tokenizer file, which is installed on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(tokenizer)
        if counter is None:
            counter = _COUNTERS[tokenizer] = PrefixCounter(tokenizer)
        for batch, raw in slices(batches, limit=2 * SLICE_BYTES):
            if len(counter.ids) > CACHE_PIECES:
                counter.reset()
            texts = [t.decode() for t in raw]
            cut = [counter.cut(t) for t in texts]
            counter.learn()
            totals = np.fromiter(map(counter.total, cut), dtype=np.int64, count=len(cut))
            sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
            cuts = sizes.copy()
            for k in np.flatnonzero(totals > limit).tolist():
                cuts[k] = counter.cut_at(texts[k], cut[k], limit)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(totals), pa.array(totals > limit), pa.array(cuts)], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long"
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)
