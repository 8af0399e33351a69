"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document.  Their votes form one of 3^m patterns; the counts of the
patterns over all documents are all that expectation-maximisation needs to estimate each labeller's accuracies and
the posterior of every pattern, so the driver handles at most 3^m rows however large the corpus.  The
posteriors of a sample train a logistic scorer over hashed byte 4-grams and hashed text statistics: TRAINERS tasks each fit
their part of the sample, and the weights are averaged.  The sample holds some SAMPLE_DOCS documents and SAMPLE_BYTES bytes at
most (chosen by a hash of id and text), none of them over TRAIN_TEXT_BYTES.  Every document is scored by that scorer over
its whole text and kept if its score reaches ``keep_at``; a score equal to it is kept.

A document's 4-grams are those of its own bytes and up to three blanks after them.  Weights are fixed-point numbers, so a score
does not depend on the order of summation, on a text's neighbours or on partitions.  Texts over PIECE bytes are summed
piece by piece.

Gold labels are not used for training; tests measure against them.

Defined cases: null and blank texts score 0 and are rejected; where there is no document to train on (an empty table, only blank
or overlong texts) all score 0; equal texts get equal scores; null ids are kept as they are; further columns pass
through the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import PIECE, mixed, pieces, slices
from .common import text_or_empty

SAMPLE_DOCS, TRAINERS, BUCKET_BITS, EPOCHS, KEEP_AT, EM_ROUNDS, SEED, ANCHOR = 16_000, 8, 16, 60, 0.5, 100, 7, 0.01
SAMPLE_BYTES, TRAIN_TEXT_BYTES, UNIT = 64 << 20, 1 << 20, 2.0**32
GOOD, BAD, ABSTAIN = 1, 0, 2
_SYMBOLS, _UPPER, _LOWER, _BLANK = b"#$%&*|<>{}[]=~^\\_@+", bytes(range(65, 91)), bytes(range(97, 123)), b" \t\n\r\x0b\x0c"
_NO_LETTER = bytes(b for b in range(128) if not chr(b).isalpha())
_STAT_NAMES = ("symbols", "marked", "upper", "capitals", "doubled", "letters", "distinct", "repeated", "word_length")
#: Each labeller: statistic, bad below, good from, good to, bad above, and the least number of words it judges.
LABELLERS = (
    ("symbols", -1, 0, 0.01, 0.03, 3), ("marked", -1, 0, 0.05, 0.2, 3), ("upper", -1, 0, 0.15, 0.3, 3), ("capitals", -1, 0, 0.1, 0.3, 3), ("doubled", -1, 0, 0.03, 0.15, 3),
    ("letters", 0.87, 0.93, 2, 3, 3), ("distinct", 0.12, 0.25, 2, 3, 30), ("repeated", -1, 0, 0.05, 0.15, 8), ("word_length", 1.5, 2.0, 14.0, 20.0, 8),
)
#: The defect that each labeller looks for (0 is the class of good documents): odd marks, capitals, repetition.
KINDS = (1, 1, 2, 2, 1, 1, 3, 3, 3)
_DOUBLES = (b"!!", b"??", b"**", b"$$", b"##", b"&&", b"%%", b" | ", b"~~", b"==")


def statistics(text: bytes) -> list[float]:
    """Number of words, then the statistics of _STAT_NAMES."""
    n = marked = capitals = repeated = length = 0
    known: set[bytes] = set()
    for part in pieces(text, 1):
        words = part.split()
        repeated += sum(map(bytes.__eq__, words, words[1:]))
        words = words[1:] if n else words  # a further piece begins with the last word of the one before
        n, length, capitals = n + len(words), length + sum(map(len, words)), capitals + sum(map(bytes.isupper, words))
        marked += sum(w[-1] in b"#$%&*|!~^=" for w in words)
        known.update(words)
    without = lambda chars: (len(text) - len(text.translate(None, chars)))
    solid, upper, lower = max(1, len(text) - without(_BLANK)), without(_UPPER), without(_LOWER)
    return [
        n, without(_SYMBOLS) / solid, marked / max(1, n), upper / max(1, upper + lower), capitals / max(1, n), sum(map(text.count, _DOUBLES)) / max(1, n),
        (solid - without(_NO_LETTER) + without(_BLANK)) / solid, len(known) / max(1, n), repeated / max(1, n - 1), length / max(1, n),
    ]


def votes(stats: np.ndarray) -> np.ndarray:
    """Votes (documents x labellers) from statistics (documents x (1 + statistics))."""
    out = np.full((len(stats), len(LABELLERS)), ABSTAIN, dtype=np.int8)
    for j, (name, bad_below, good_from, good_to, bad_above, words) in enumerate(LABELLERS):
        x, judged = stats[:, 1 + _STAT_NAMES.index(name)], stats[:, 0] >= words
        out[judged & (x >= good_from) & (x <= good_to), j] = GOOD
        out[judged & ((x < bad_below) | (x > bad_above)), j] = BAD
    return out


def _pattern(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


def pattern_counts(docs: DataFrame) -> tuple[dict[int, int], int]:
    """How many of all documents show each voting pattern, and the bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            keys, at = np.unique(_pattern(votes(np.array([statistics(t) for t in texts]))), return_inverse=True)
            size = np.bincount(at, weights=list(map(len, texts))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at)), pa.array(size)], names=["pattern", "n", "size"])

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(run, "pattern long, n long, size long").groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("size").alias("size")).collect()
    return {r["pattern"]: r["n"] for r in rows}, sum(r["size"] for r in rows)


def fit_labellers(counts: dict[int, int], rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """EM for P(bad vote | class) per labeller (labellers x classes), class shares, and P(good | pattern).

    The latent classes are good (0) and the kinds of defect that labellers look for: labellers of one kind overlap,
    those of different kinds say little of each other.  An abstention carries no evidence.  Weak Beta priors
    (ANCHOR of the documents) tie the classes to their names: a labeller seldom calls a document bad, but often
    one of its own kind.
    """
    patterns, m, kinds = sorted(counts), len(LABELLERS), max(KINDS) + 1
    n = np.array([counts[p] for p in patterns], dtype=float)
    v = np.array([[p // 3**j % 3 for j in range(m)] for p in patterns]).reshape(-1, m)
    own = np.array([[k == c for c in range(kinds)] for k in KINDS])
    belief = np.exp(3.0 * (v == BAD) @ own)
    belief /= belief.sum(axis=1, keepdims=True)
    weight = ANCHOR * n.sum()
    for _ in range(rounds):
        share = np.maximum((n[:, None] * belief).sum(0) / n.sum(), 1e-4)
        bad, seen = ((v == BAD).T @ (n[:, None] * belief)), ((v != ABSTAIN).T @ (n[:, None] * belief))
        table = (bad + weight * np.where(own, 0.6, 0.01)) / (seen + weight)
        logs = (v == BAD) @ np.log(table) + (v == GOOD) @ np.log(1 - table) + np.log(share)
        belief = np.exp(logs - logs.max(axis=1, keepdims=True))
        belief /= belief.sum(axis=1, keepdims=True)
    return table, share, dict(zip(patterns, belief[:, 0].tolist()))


def _gram_buckets(data: np.ndarray) -> np.ndarray:
    n = len(data) - 3
    wide = data[:n] | data[1 : n + 1] << np.uint32(8) | data[2 : n + 2] << np.uint32(16) | data[3:] << np.uint32(24)
    return ((wide * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 4-grams of each text with its blanks (one more than its bytes), and how many each text has."""
    counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    grams = _gram_buckets(np.frombuffer(b"".join(t + b"    " for t in texts), dtype=np.uint8).astype(np.uint32))
    own = np.ones(len(grams) + 3, dtype=bool)
    ends = np.cumsum(counts + 3)
    for k in (1, 2, 3):  # those that reach into the next text
        own[ends - k] = False
    return grams[own[:-3]], counts


def _stat_buckets(stats: np.ndarray) -> np.ndarray:
    scale = np.array([100, 15, 15, 15, 15, 30, 15, 30, 1])
    steps = np.minimum(15, np.floor(np.c_[stats[:, 1:] * scale, np.log2(1 + stats[:, 0])]))
    return (mixed((np.arange(1, steps.shape[1] + 1) * 16 + steps).astype(np.uint64)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _train(texts: list[bytes], posterior: dict[int, float]) -> np.ndarray:
    """Logistic regression with soft labels by full-batch Adam."""
    stats = np.array([statistics(t) for t in texts])
    target = np.array([posterior.get(p, 0.5) for p in _pattern(votes(stats)).tolist()])
    (grams, counts), stat_keys = _grams(texts), _stat_buckets(stats)
    begins, owner = np.cumsum(counts) - counts, np.repeat(np.arange(len(texts), dtype=np.int32), counts)
    w = np.zeros((1 << BUCKET_BITS) + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    share = np.array([(1 - target).mean(), target.mean()])  # both classes weigh the same
    balance = np.where(target >= 0.5, 0.5 / max(share[1], 1e-3), 0.5 / max(share[0], 1e-3))
    for epoch in range(1, EPOCHS + 1):
        z = 4 * np.add.reduceat(w[grams], begins) / counts + w[stat_keys].sum(1) + w[-1]
        slope = balance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(texts)
        grad = np.bincount(grams, weights=(4 * slope / counts)[owner], minlength=len(w))
        grad += np.bincount(stat_keys.ravel(), weights=np.repeat(slope, stat_keys.shape[1]), minlength=len(w))
        grad[-1] += slope.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w -= 0.1 * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.99**epoch)) + 1e-9)
    return w


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray | None:
    """Weights of the scorer in units of 1 / UNIT, 2^BUCKET_BITS + 1 numbers; None if there is no document to train on."""
    counts, size = pattern_counts(docs)
    if not size:
        return None
    posterior = fit_labellers(counts)[2]
    share = min(1.0, sample_docs / sum(counts.values()), sample_bytes / size)
    text = text_or_empty()
    draw = F.xxhash64("doc_id", text, F.lit(SEED))  # with the id: copies of one text do not come all together
    sample = docs.select(text.alias("text"), draw.alias("draw")).where((F.pmod("draw", F.lit(1_000_003)) / 1_000_003 < share) & F.octet_length("text").between(1, TRAIN_TEXT_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}  # a TRAINERS-th of the bounded sample for each part
        for batch, texts in slices(batches):
            for part, t in zip(batch.column("part").to_pylist(), texts):
                held.setdefault(part, []).append(t)
        for part, texts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_train(texts, posterior).tobytes()], pa.binary()), pa.array([len(texts)], pa.int64())], names=["part", "weights", "n"])

    sample = sample.withColumn("part", F.pmod("draw", F.lit(TRAINERS)).cast("int")).repartition(TRAINERS, "part").sortWithinPartitions("part", "draw", "text")
    parts = sample.select("part", "text").mapInArrow(run, "part int, weights binary, n long").collect()  # TRAINERS vectors, however many partitions
    if not parts:
        return None
    total = sum(np.frombuffer(r["weights"]) * r["n"] for r in sorted(parts, key=lambda r: r["part"]))
    return np.round(total / sum(r["n"] for r in parts) * UNIT).astype(np.int64)


def _score(texts: list[bytes], weights: np.ndarray | None) -> np.ndarray:
    if weights is None or not texts:
        return np.zeros(len(texts))
    stats = np.array([statistics(t) for t in texts])
    if max(map(len, texts)) > PIECE:
        sums, counts = np.zeros(len(texts), dtype=np.int64), np.array([len(t) + 1 for t in texts])
        for i, t in enumerate(texts):
            for at in range(0, len(t) + 1, PIECE):
                part = t[at : at + PIECE + 3]
                data = np.frombuffer(part + b"    "[: at + PIECE + 3 - len(t)] if at + PIECE + 3 > len(t) else part, dtype=np.uint8)
                sums[i] += weights[_gram_buckets(data.astype(np.uint32))[: len(t) + 1 - at]].sum()
    else:
        grams, counts = _grams(texts)
        sums = np.add.reduceat(weights[grams], np.cumsum(counts) - counts)
    z = (4 * (sums / counts) + weights[_stat_buckets(stats)].sum(1) + weights[-1]) / UNIT
    return np.where(stats[:, 0] > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)


def quality_scores(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), keep."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs))  # 512 KB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            score = _score(texts, held.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(score >= keep_at)], names=["doc_id", "score", "keep"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, keep boolean")


def quality_filter(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The documents that the classifier keeps, with all their columns; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield batch.filter(pa.array(_score(texts, held.value) >= keep_at))

    return docs.mapInArrow(run, docs.schema)
