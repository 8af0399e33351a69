"""Exact vector search in blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS, QUERIES = 20_000, 2_000
#: Scores that a task holds at once, whatever its blocks: 8 MB of doubles for each matrix on the way.
CELLS = 1_000_000


def best_of(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A function that takes vectors and queries to the k best per query and collection, in slices of ``CELLS`` scores; it is sent to workers whole."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "collection": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "collection": "int32"})
        if not len(left) or not len(right):
            return none
        left = left.sort_values(["collection", "vec_id"], kind="stable")
        ids, kinds, asking = left["vec_id"].to_numpy(), left["collection"].to_numpy(), right["vec_id"].to_numpy()
        e, q = (np.stack(x["embedding"].to_numpy()).astype(float) for x in (left, right))
        long_e, long_q = np.linalg.norm(e, axis=1), np.linalg.norm(q, axis=1)
        firsts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
        out, step = [none], max(1, CELLS // len(e))
        for at in range(0, len(q), step):
            some = slice(at, at + step)
            for a, b in zip(firsts, [*firsts[1:], len(e)]):  # a collection's rows, by id
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.round((q[some] @ e[a:b].T) / (long_q[some, None] * long_e[None, a:b]), 6)
                score[np.isnan(score) | (asking[some, None] == ids[None, a:b])] = -np.inf
                least = np.partition(score, max(0, b - a - k), axis=1)[:, max(0, b - a - k)]  # each query's k-th best
                asked_by, found = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                value = score[asked_by, found]
                order = np.lexsort((found, -value, asked_by))
                asked_by, found, value = asked_by[order], found[order], value[order]
                new = np.flatnonzero(np.r_[True, asked_by[1:] != asked_by[:-1]]) if len(asked_by) else np.array([], int)
                own = np.arange(len(asked_by)) - np.repeat(new, np.diff(np.r_[new, len(asked_by)])) < k
                out.append(pd.DataFrame({"query_id": asking[some][asked_by[own]], "vec_id": ids[a:b][found[own]], "collection": np.int32(kinds[a]), "score": value[own]}))
        return pd.concat(out, ignore_index=True)

    return best


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, rows: int = ROWS, asked: int = QUERIES) -> DataFrame:
    """The k best by cosine, per query and collection, of all vectors (vec_id, collection, embedding) but the query itself.

    Vectors and queries are dealt into blocks of some ``rows`` and ``asked``; every pair of blocks is one task's matrix product, which
    passes on its k best only; its scores are computed in slices.  Scores are rounded to six digits, ties go to the smaller id; a zero vector scores nothing.
    """
    blocks = max(1, -(-vectors.count() // rows)), max(1, -(-queries.count() // asked))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        at = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(own)
        return df.select("*", at, F.explode(F.expr(f"sequence(0, {m - 1})")).alias(other))

    left, right = dealt(vectors, "i", blocks[0], "j", blocks[1]), dealt(queries, "j", blocks[1], "i", blocks[0])
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(best_of(k), "query_id long, vec_id long, collection int, score double")
    place = F.row_number().over(Window.partitionBy("query_id", "collection").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("_k", place).where(F.col("_k") <= k).drop("_k")
