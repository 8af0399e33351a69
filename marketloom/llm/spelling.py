"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

A word is a run of letters (A-Z, a-z, U+00C0 to U+00FF) of at least LEAST_LENGTH code points that occurs LEAST_COUNT times.  Two words are near if one
inserted, deleted or replaced code point makes one the other.  A pair whose longer word has m code points is searched with grams of
q = min((m - 1) // 2, LONGEST_GRAM) code points.  One edit spoils at most q of the longer word's grams, so near words share at least
t = m - 2q + 1 grams, at the same place or (behind an edit that changes the length) one place apart.

So a word is posted under its first (number of grams - t + 1) grams only, in the order of their frequency, rarest first: near words share
one of these.  Frequencies are counted in SLOTS counters, however many grams there are; any fixed order is right, a good one keeps lists short.  Posting lists
meet in tasks by gram, place and m.  There the lists of a word's other grams, limited to that list, are merged: members that
share fewer than t grams are dropped, the rest is compared letter by letter.  A list of more than ``block`` postings (by a bound from counters, too) is split
into blocks, and every two blocks meet in one task, so that memory is bounded and no pair is lost.

The form of a word is its near word of largest count (ties: the smaller in code-point order) if that count is at least twice its own.  Counts
double along forms, so the last form is found in a few rounds of pointer jumping.

Defined cases: a null text has no words; a null doc_id counts as an empty one in the hash that decides on deletions; bytes that are no UTF-8 are no letters; texts of any
length go whole, long ones in parts cut between words; equal rows are separate rows; an empty table gives an empty result; further
input columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import mixed, slices
from .common import stored

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in so many (document, word) pairs has a letter deleted.
DELETED_ONE_IN = 97
LONGEST_GRAM = 5
SLOTS = 1 << 20
BLOCK = 100_000
#: Postings and pairs that a task works on at once, and the width up to which words are compared in columns.
ROWS_AT_ONCE, PAIRS_AT_ONCE, WIDTH = 50_000, 1_000_000, 48
#: Characters of a long text that are searched at once.
PART = 1 << 20
_RUN, _OTHER = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"), re.compile("[^a-zÀ-ÿ]")


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART:
        other = _OTHER.search(text, at + PART)
        end = other.start() if other else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for batch, texts in slices(batches):
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), texts):
            start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
            for part in _parts(raw.lower().decode("utf-8", "replace")):  # lower() of bytes changes A-Z only
                for run, n in Counter(_RUN.findall(part)).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % DELETED_ONE_IN == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LENGTH:
                            continue
                    total[run] = total.get(run, 0) + n
                if len(total) > 200_000:
                    yield out()
                    total.clear()
    if total:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: after the deletions."""
    counts = docs.select("doc_id", "text").mapInArrow(_counter, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Words:
    """Words as one buffer of Latin-1 letters: a gram of up to eight letters is one number."""

    def __init__(self, column: pa.Array):
        self.words = column.to_pylist()
        self.length = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.start = np.cumsum(self.length) - self.length
        self.letters = np.frombuffer(b"".join(self.words) + bytes(8), dtype=np.uint8)
        wide = self.letters.astype(np.uint64)
        self.packed = np.zeros(len(wide) - 8, dtype=np.uint64)
        for i in range(LONGEST_GRAM):
            self.packed |= wide[i : len(wide) - 8 + i] << np.uint64(8 * i)

    def grams(self, rows: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words (by row) as members of pairs whose longer word has m letters: owner (index into rows), place and gram."""
        q = gram_length(m)
        n = self.length[rows] - q + 1
        owner = np.repeat(np.arange(len(rows)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gram = self.packed[self.start[rows][owner] + place] & ((np.uint64(1) << (8 * q[owner]).astype(np.uint64)) - np.uint64(1))
        return owner, place, gram


def gram_length(m: np.ndarray) -> np.ndarray:
    return np.minimum((m - 1) // 2, LONGEST_GRAM)


def least_shared(m: np.ndarray) -> np.ndarray:
    return m - 2 * gram_length(m) + 1


def _gram_hash(gram: np.ndarray, m: np.ndarray) -> np.ndarray:
    return mixed(gram + (m.astype(np.uint64) << np.uint64(48)))


def _key(gram_hash: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mixed(gram_hash + place.astype(np.uint64))


def _roles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Every word twice: as the longer (or equal) word of a pair and as the shorter one; row and m."""
    every = np.arange(len(words.words))
    return np.concatenate([every, every]), np.concatenate([words.length, words.length + 1])


def _slot(value: np.ndarray) -> np.ndarray:
    return (value & np.uint64(SLOTS - 1)).astype(np.int64)


def postings(words: Words, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, m and key of all postings; a shorter word is posted at both places where a longer one may have the gram."""
    rows, m = _roles(words)
    owner, place, gram = words.grams(rows, m)
    h = _gram_hash(gram, m[owner])
    order = np.lexsort((place, h, frequency[_slot(h)], owner))  # rarest first, the same order for every word
    owner, place, h = owner[order], place[order], h[order]
    n = np.bincount(owner, minlength=len(rows))
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = rank < (n - least_shared(m) + 1)[owner]
    owner, place, h = owner[first], place[first], h[first]
    short = words.length[rows[owner]] < m[owner]
    owner, place, h = np.concatenate([owner, owner[short]]), np.concatenate([place, place[short] + 1]), np.concatenate([h, h[short]])
    return rows[owner], m[owner], _key(h, place)


def _tally(slots: Callable[[Words], np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(slots(Words(batch.column("word"))), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    return run


def _tallied(words: DataFrame, slots: Callable[[Words], np.ndarray]) -> np.ndarray:
    """SLOTS counters over all words."""
    sums = words.select("word").mapInArrow(_tally(slots), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, dtype=np.int64)
    out[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return out


def _gram_slots(words: Words) -> np.ndarray:
    rows, m = _roles(words)
    owner, _, gram = words.grams(rows, m)
    return _slot(_gram_hash(gram, m[owner]))


def _poster(frequency, crowded, block: int) -> Callable:
    """Postings with their cell; side 0: the whole list, 1 and 2: one of two blocks of a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                words = Words(part.column("word"))
                if not words.words:
                    continue
                row, m, key = postings(words, frequency.value)
                blocks = -(-crowded.value[_slot(key)] // block)
                times = np.maximum(blocks, 1)
                own = np.array([zlib.crc32(w) for w in words.words], dtype=np.int64)[row] % times if times.max() > 1 else 0 * row
                which = np.repeat(np.arange(len(row)), times)
                other = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                mine = own[which]
                low, high = np.minimum(mine, other), np.maximum(mine, other)
                cell, side = (low << 32) + high, np.where(mine == other, 0, np.where(mine < other, 1, 2))
                # the inside of a block is searched in its own cell; elsewhere its rows meet only those of the other block
                row, m, key = row[which], m[which], key[which]
                columns = [pa.array(key.view(np.int64)), pa.array(cell), pa.array(m.astype(np.int32)), pa.array(side.astype(np.int8))]
                yield pa.RecordBatch.from_arrays([*columns, part.column("word").take(pa.array(row)), part.column("n").take(pa.array(row))], ["key", "cell", "m", "side", "word", "n"])

    return run


POSTING = "key long, cell long, m int, side byte, word binary, n long"


def _one_edit(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (the longer first) are one edit apart."""
    out = np.zeros(len(a), dtype=bool)
    la, lb = words.length[a], words.length[b]
    wide = la > WIDTH
    for k in np.flatnonzero(wide):  # words of over 48 letters are few once the count filter has passed
        x, y = words.words[a[k]], words.words[b[k]]
        at = next((i for i in range(len(y)) if x[i] != y[i]), len(y))
        out[k] = x != y and x[at + 1 :] == y[at + (len(x) == len(y)) :]
    some, at = np.flatnonzero(~wide), np.arange(WIDTH)
    letters = np.concatenate([words.letters, np.zeros(WIDTH + 1, np.uint8)])
    for s in range(0, len(some), 50_000):
        k = some[s : s + 50_000]
        x, y = letters[words.start[a[k]][:, None] + np.arange(WIDTH + 1)], letters[words.start[b[k]][:, None] + at]
        inside = at < lb[k][:, None]
        differ = (x[:, :WIDTH] != y) & inside
        first = np.where(differ.any(1), differ.argmax(1), lb[k])
        behind = ((x[:, 1:] != y) & inside & (at >= first[:, None])).any(1)
        out[k] = np.where(la[k] == lb[k], differ.sum(1) == 1, ~behind)
    return out


def _matches(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Near pairs among the complete posting lists of a batch that is sorted by key and cell."""
    key, cell = batch.column("key").to_numpy(), batch.column("cell").to_numpy()
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
    group = np.cumsum(new) - 1
    kept = np.flatnonzero(np.bincount(group)[group] > 1)  # a list of one posting has no pair
    batch, group, key = batch.take(pa.array(kept)), group[kept], key[kept]
    words = Words(batch.column("word"))
    m, side = batch.column("m").to_numpy().astype(np.int64), batch.column("side").to_numpy()
    short = words.length < m
    owner, place, gram = words.grams(np.arange(len(m)), m)
    h = _gram_hash(gram, m[owner])
    behind = short[owner]
    owner, place, h = np.concatenate([owner, owner[behind]]), np.concatenate([place, place[behind] + 1]), np.concatenate([h, h[behind]])
    k = _key(h, place)
    other = k != key.view(np.uint64)[owner]  # every member has the list's own gram
    owner, k = owner[other], mixed(k[other] + group[owner[other]].astype(np.uint64))
    # lists inside the list: equal code, longer words first, so that each pair is seen from its longer word alone
    order = np.lexsort((owner, short[owner], k))
    k, owner = k[order], owner[order]
    ends = np.flatnonzero(np.append(k[1:] != k[:-1], True)) + 1 if len(k) else np.zeros(0, np.int64)
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    partners = np.where(short[owner], 0, end - np.arange(len(k)) - 1)
    probe = np.flatnonzero(partners)
    probe = probe[np.argsort(owner[probe], kind="stable")]  # all lists of a word together, to be merged
    total = np.cumsum(partners[probe])
    found = []
    at = 0
    while at < len(probe):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        to = int(np.searchsorted(owner[probe], owner[probe[to - 1]], side="right"))
        part = probe[at:to]
        n = partners[part]
        left = np.repeat(part, n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        a, b = owner[left], owner[right]
        meet = (a != b) & ((side[a] == 0) | (side[a] != side[b]))
        pair, shared = np.unique(a[meet] * len(m) + b[meet], return_counts=True)
        a, b = pair // len(m), pair % len(m)
        enough = shared + 1 >= least_shared(m[a])
        a, b = a[enough], b[enough]
        near = _one_edit(words, a, b)
        found.append(np.stack([a[near], b[near]]))
        at = to
    a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    word, n = batch.column("word"), batch.column("n")
    a, b = pa.array(a), pa.array(b)
    return pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], ["a", "a_n", "b", "b_n"])


def _joiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of sorted postings, some complete lists at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= ROWS_AT_ONCE:
            whole = joined()
            key, cell = whole.column("key").to_numpy(), whole.column("cell").to_numpy()
            cut = int(np.flatnonzero((key != key[-1]) | (cell != cell[-1]))[-1]) + 1 if ((key != key[-1]) | (cell != cell[-1])).any() else 0
            if cut:
                yield _matches(whole.slice(0, cut))
            held, size = [whole.slice(cut)], whole.num_rows - cut
    if size:
        yield _matches(joined())


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every pair of near words once: a, a_n, b, b_n (words as Latin-1 bytes, the longer first), from word and n."""
    spark = words.sparkSession
    frequency = spark.sparkContext.broadcast(_tallied(words, _gram_slots))  # SLOTS numbers
    of_keys = lambda w: _slot(postings(w, frequency.value)[2]) if w.words else np.zeros(0, np.int64)
    crowded = spark.sparkContext.broadcast(_tallied(words, of_keys))
    posted = words.select("word", "n").mapInArrow(_poster(frequency, crowded, block), POSTING)
    pairs = posted.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(_joiner, "a binary, a_n long, b binary, b_n long")
    # equal lengths: either word may come first, under different grams
    swap = (F.length("a") == F.length("b")) & (F.col("b") < F.col("a"))
    return pairs.select(*[F.when(swap, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("b", "a"), ("b_n", "a_n"), ("a", "b"), ("a_n", "b_n"))]).distinct()


def spelling_forms(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    latin = F.expr("encode(word, 'ISO-8859-1')")
    words = stored(word_counts(docs).select(latin.alias("word"), "n"), "spelling-words")
    pairs = near_words(words, block)
    both = pairs.select(F.explode(F.array(*[F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")])).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    near = words.join(best, "word", "left").withColumn("fits", F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False)))
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("fits"), F.col("best.near")).alias("form"), F.when(F.col("fits"), -F.col("best.less")).alias("form_n"))
    near = stored(near, "spelling-forms")
    roots = _roots(near.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    out = near.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    text = lambda c: F.expr(f"decode({c}, 'ISO-8859-1')").alias(c)
    return out.select(text("word"), text("form"), text("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """From (word, root = its form): the last form, by pointer jumping."""
    links = stored(links, "spelling-roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = stored(links.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        if moved.where("_moved").isEmpty():
            return moved.select("word", "root")
        links = moved.select("word", "root")


FORMS_SQL = f"""
WITH RECURSIVE run AS (SELECT doc_id, run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= {LEAST_LENGTH} GROUP BY ALL),
bytes AS (SELECT key, list_transform(range(1, len(hex(key)), 2), lambda i: ('0x' || substr(hex(key), i, 2))::UINTEGER) AS b FROM (SELECT DISTINCT key FROM run)),
crc AS (SELECT key, xor(list_reduce(list_prepend(4294967295::UINTEGER, b), lambda c, x: list_reduce(list_prepend(xor(c, x), list_resize([]::UINTEGER[], 8, 0::UINTEGER)),
  lambda v, z: xor(v // 2, (v % 2) * 3988292384::UINTEGER))), 4294967295::UINTEGER) AS h FROM bytes),
edited AS (SELECT CASE WHEN h % {DELETED_ONE_IN} = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, n FROM run JOIN crc USING (key)),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT DISTINCT word, n, pos, left(word, pos::INTEGER - 1) || substr(word, pos::INTEGER + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS last, 0 AS step FROM formed UNION ALL SELECT walk.word, form, step + 1 FROM walk JOIN formed ON formed.word = walk.last WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(last, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""
