"""The pruned index against a full search, on data it can prune and on data it cannot."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators.retrieval import PrunedIndex, context, per_collection

SCHEMA = "vec_id long, collection int, embedding array<double>"


def full(rows, queries, k):
    width = max(len(x) for _, _, x in rows if x)
    fine = [(i, c, np.array([*x, *[0.0] * (width - len(x))])) for i, c, x in rows if i is not None and c is not None and x is not None and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    out = []
    for q, _, y in [r for r in fine if r[0] in queries]:
        for c in {r[1] for r in fine}:
            scored = sorted(((-round(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), 6), i) for i, kind, x in fine if kind == c and i != q))
            out += [(q, c, i, -s) for s, i in scored[:k]]
    return sorted(out)


def clustered(seed, n, dim, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(15)]
    return [(i, rng.choice([0, 0, 0, 1, 2]), [v + rng.gauss(0, spread) for v in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_equals_a_full_search(spark, spread):
    rows = clustered(1, 700, 12, spread)
    rows += [(1000 + i, 0, rows[5][2]) for i in range(30)]  # copies: ties go to the smaller id
    rows += [(2000, 0, None), (2001, 1, [None] * 12), (2002, 1, [float("nan")] * 12), (2003, 1, [0.0] * 12), (2004, 2, rows[7][2][:9]), (None, 1, rows[8][2]), (2005, None, rows[8][2]), (2006, 7, rows[9][2])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "2 as score", "3 as away")
    asked = {i for i in range(0, 700, 50)} | {1003, 2004, 2006}
    index = PrunedIndex(df, sample=300, block=40)
    assert index.rows.count() == 700 + 30 + 2  # every vector that can be compared is filed
    got = sorted(map(tuple, index.search(df.where(F.col("vec_id").isin(*asked)), 4).collect()))
    want = full(rows, asked, 4)
    assert [(q, c, i) for q, c, i, _ in got] == [(q, c, i) for q, c, i, _ in want]
    assert max(abs(a[3] - b[3]) for a, b in zip(got, want)) < 2e-6


def test_few_vectors_and_none(spark):
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.query_id, r.collection, r.vec_id) for r in PrunedIndex(df).search(df, 5).collect()) == [(1, 0, 2), (1, 1, 3), (2, 0, 1), (2, 1, 3), (3, 0, 1), (3, 0, 2)]
    assert PrunedIndex(df.limit(0)).search(df, 5).count() == 0 and PrunedIndex(df).search(df.limit(0), 5).count() == 0


def test_context_is_ordered_and_cut(spark):
    found = spark.createDataFrame([(1, c, 10 * c + j, 0.9 - j / 10) for c in (2, 0, 1) for j in range(3)] + [(2, 0, 5, 0.1)], "query_id long, collection int, vec_id long, score double")
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(30) if i != 1] + [(1, None)], "vec_id long, text string")
    got = {r.query_id: (r.chunks, r.context) for r in context(found, texts, 5).collect()}
    assert got[1] == (5, "\n\n".join(f"[Context {k}] t{i}" for k, i in enumerate((0, 2, 10, 11, 12), 1)))
    assert got[2] == (1, "[Context 1] t5") and per_collection(3) == 2 and per_collection(9) == 3
