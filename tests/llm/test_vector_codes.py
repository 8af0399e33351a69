"""Vector codes against plain Lloyd rounds in whole numbers, and the bounds that prune."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm.vector_codes import Codebook, below, exact, first_assignment, packed, reassignment, to_all, unpacked, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    rows = [(i, [math.floor(1024 * v) for v in x], label) for i, x, label in rows if x is not None and all(v is not None and math.isfinite(v) and abs(v) < 2**52 for v in x)]
    width = -(-max((len(x) for _, x, _ in rows), default=0) // parts) * parts
    rows = sorted(((i, x + [0] * (width - len(x)), label) for i, x, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    size = width // parts
    cut = lambda x, m: x[m * size : (m + 1) * size]
    books = [[cut(x, m) for _, x, _ in rows[:entries]] for m in range(parts)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    near = lambda x, book: min((far(x, c), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for m in range(parts):
            at = [near(cut(x, m), books[m])[1] for _, x, _ in rows]
            for j in range(len(books[m])):
                mine = [cut(x, m) for (_, x, _), a in zip(rows, at) if a == j]
                if mine:
                    books[m][j] = [sum(v) // len(mine) for v in zip(*mine)]
    digest = hashlib.sha256(",".join(str(v) for book in books for c in book for v in c).encode()).hexdigest()
    out, total = [], {}
    for i, x, label in rows:
        found = [near(cut(x, m), books[m]) for m in range(parts)]
        error = sum(d for d, _ in found)
        total[label] = total.get(label, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, label))
    cap = lambda v: v if v < 2**63 else None
    bad = {label for _, _, e, label in out if e >= 2**63}
    return sorted(((i, code, cap(e), None if label in bad else cap(total[label]), digest) for i, code, e, label in out), key=str)


def check(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(7).alias(c) for c in ("x", "code", "error", "_label", "_spread", "label_error", "_salt", "upper")])
    got = vector_codes(df.repartition(3), **kwargs)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == plain(rows, **kwargs)
    return got


def clustered(rng, n, dim=16, spread=0.05):
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(12)]
    return [(i, [v + rng.gauss(0, spread) for v in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(n)]


def test_codes_equal_plain_rounds(spark):
    rng = random.Random(4)
    rows = clustered(rng, 400)
    rows += [(None, rows[0][1], 1), (5, rows[9][1], 2), (5, rows[9][1], 2), (900, None, 1), (901, [math.nan] * 16, 1), (902, [math.inf] + [0.0] * 15, 1), (903, [None] + [0.0] * 15, 1), (904, [1e300] * 16, 1)]
    check(spark, rows, entries=24)


def test_ties_go_to_the_lower_index(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(8)], 1) for i in range(200)]  # many equal rows and distances
    check(spark, rows, entries=40)


def test_few_rows_odd_lengths_and_wide_numbers(spark):
    rng = random.Random(6)
    check(spark, [(3, [0.5] * 8, None), (1, [0.25] * 8, 1)])
    check(spark, [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([0, 3, 6]))], 1) for i in range(40)], entries=9)
    wide = [(i, [rng.uniform(-1, 1) * rng.choice([1, 1e6, 4e15]) for _ in range(8)], i % 3) for i in range(60)]
    assert any(r[2] is None for r in check(spark, wide, entries=7))
    check(spark, [(i, [], 1) for i in range(5)])


def test_no_rows(spark):
    assert vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0


def test_production_size_on_given_vectors(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    rows = [(r.vec_id, [float(v) for v in r.embedding], r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(spark, rows, rounds=2)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(7)
    centres = rng.integers(-3000, 3000, (40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-150, 150, (3000, 16))).astype(np.int64)
    book = Codebook(x[:40].copy())
    at, upper, lower = first_assignment(x, book)
    done = 0
    for _ in range(4):
        entries = np.stack([x[at == j].sum(0) // max(1, (at == j).sum()) if (at == j).any() else book.entries[j] for j in range(40)])
        book = Codebook(entries, book.entries)
        stored = unpacked(packed(lower))
        assert (stored <= lower).all() and (lower - stored <= lower.max(1)[:, None] / 200).all()
        at, upper, lower, count = reassignment(x, book, at, upper, stored)
        d = to_all(x, entries)
        assert (at == d.argmin(1)).all() and (lower <= np.sqrt(d)).all() and (upper >= np.sqrt(d[np.arange(len(x)), at])).all()
        done += count
    assert done < 4 * x.shape[0] * 40 / 3  # most distances are never computed


def test_exact_distances_beyond_64_bits():
    big = np.array([[2**61, -(2**61)]], dtype=np.int64)
    assert exact(big, -big)[0] == 2 * (2**62) ** 2 and to_all(big, -big)[0, 0] == 2 * (2**62) ** 2
    assert below(np.array([9]))[0] <= 3
