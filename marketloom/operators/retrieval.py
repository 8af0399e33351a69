"""Exact nearest neighbours by cosine through a pruned index, and the context that is assembled from them.

Unit vectors are filed under the nearest of some centres, which are fitted to a bounded sample; every vector is filed.  Of each centre and
collection the farthest member is known.  A query is first searched in the filed lists nearest to it that hold k members of each collection together; the k-th best
score found is its bar.  By the triangle inequality no member of a list can be nearer to the query than the query's distance from the centre less the
list's radius, nor than the difference of their distances from the centre, so lists and members that cannot reach the bar are left out, and the
rest are searched.  The result is that of a full search.

Lists are dealt into blocks of at most some BLOCK members, whatever their size, and a task holds one block and the queries that ask for it, QUERIES at a
time; a task passes on its k best only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import scratch

#: Rows that the centres are fitted to (at most, in expectation), rounds of fitting, and bounds of the work of a task.
SAMPLE, ROUNDS, BLOCK, QUERIES = 20_000, 6, 20_000, 500
#: Scores are compared rounded to six digits: a bound has to miss the bar by more than rounding can move it.
SLACK = 2e-6
FOUND = "query_id long, collection int, vec_id long, score double"


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "retrieval")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, collection, unit: vectors without null, NaN or infinite components, scaled to length 1; zero vectors are left out.

    Vectors of unequal lengths are padded with zeros to the longest.
    """
    fine = vectors.where("vec_id IS NOT NULL AND collection IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity'))")
    width = fine.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    doubles = F.transform("embedding", lambda v: v.cast("double"))
    rows = fine.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("collection").cast("int").alias("collection"), F.concat(doubles, F.expr(f"array_repeat(0D, {width} - size(embedding))")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    return rows.withColumn("_n", norm).where("_n > 0").select("vec_id", "collection", F.transform("x", lambda v: v / F.col("_n")).alias("unit"))


def fitted_centres(units: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Some sqrt(n) centres, 256 at most, by rounds of k-means over a sample that is drawn by the id's hash."""
    n = units.count()
    drawn = units if n <= sample else units.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    x = np.array([r.unit for r in drawn.select("unit").orderBy("unit").toLocalIterator()])
    if not len(x):
        return np.zeros((1, 0))
    k = min(256, max(1, int(np.sqrt(n))), len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :]).argmin(1)
        centres = np.stack([x[at == j].mean(0) if (at == j).any() else centres[j] for j in range(k)])
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :]))


class PrunedIndex:
    """All of ``vectors`` (vec_id, collection, embedding), filed under centres."""

    def __init__(self, vectors: DataFrame, sample: int = SAMPLE, block: int = BLOCK):
        units = _stored(unit_vectors(vectors))
        self.spark, self.centres, self.block = vectors.sparkSession, fitted_centres(units, sample), block
        centres = self.centres

        def file(batches):
            for pdf in batches:
                if len(pdf):
                    d = _distances(np.stack(pdf["unit"].to_numpy()), centres)
                    part = d.argmin(1)
                    yield pdf.assign(part=part.astype("int32"), away=d[np.arange(len(d)), part])

        self.rows = _stored(units.mapInPandas(file, "vec_id long, collection int, unit array<double>, part int, away double"))
        #: A row per centre and collection: members and the farthest one's distance.
        self.lists = self.rows.groupBy("part", "collection").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()

    def _search(self, asked: DataFrame, k: int) -> DataFrame:
        """The k best per query and collection among the lists that ``asked`` (query_id, unit, part, from_centre, bar by collection) names."""
        sizes = {p: -(-sum(r.n for r in self.lists if r.part == p) // self.block) for p in {r.part for r in self.lists}}
        blocks = F.coalesce(F.element_at(F.create_map(*[x for p, n in sizes.items() for x in (F.lit(p), F.lit(n))]), F.col("part")), F.lit(1)) if sizes else F.lit(1)
        rows = self.rows.withColumn("sub", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
        asked = asked.withColumn("sub", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))

        def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": [], "collection": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "collection": "int32", "vec_id": "int64"})]
            if len(left) and len(right):
                e, ids, kinds, away = np.stack(left["unit"].to_numpy()), left["vec_id"].to_numpy(), left["collection"].to_numpy(), left["away"].to_numpy()
                for s in range(0, len(right), QUERIES):
                    part = right.iloc[s : s + QUERIES]
                    scores = np.round(np.stack(part["unit"].to_numpy()) @ e.T, 6)
                    for query, centre, bars, row in zip(part["query_id"], part["from_centre"], part["bars"], scores):
                        bars = dict(bars) if bars is not None else {}
                        for kind in np.unique(kinds):
                            bar = bars.get(int(kind), -2.0)
                            near = 1 - (away - centre) ** 2 / 2 >= bar - SLACK  # members whose distance from the centre does not rule them out
                            own = np.flatnonzero((kinds == kind) & (ids != query) & near)
                            own = own[np.lexsort((ids[own], -row[own]))[:k]]
                            out.append(pd.DataFrame({"query_id": query, "collection": np.int32(kind), "vec_id": ids[own], "score": row[own]}))
            return pd.concat(out, ignore_index=True)

        return rows.groupBy("part", "sub").cogroup(asked.groupBy("part", "sub")).applyInPandas(best, FOUND)

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id", "collection").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("_k", place).where(F.col("_k") <= k).drop("_k")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, collection, vec_id, score: the k best of every collection for each query (vec_id, collection, embedding), the query itself left
        out; scores have six digits and ties go to the smaller id."""
        lists, centres = [(r.part, r.collection, r.n, r.radius) for r in self.lists], self.centres
        kinds = sorted({c for _, c, _, _ in lists})
        if not lists:
            return self.spark.createDataFrame([], FOUND)

        def first(batches):
            for pdf in batches:
                out = []
                for query, unit, d in zip(pdf["vec_id"], pdf["unit"], _distances(np.stack(pdf["unit"].to_numpy()), centres) if len(pdf) else []):
                    have = dict.fromkeys(kinds, 0)
                    for part in np.argsort(d, kind="stable"):
                        out.append((query, unit, int(part), float(d[part]), None))
                        for p, c, n, _ in lists:
                            if p == part:
                                have[c] += n
                        if all(v > k for v in have.values()):
                            break
                yield pd.DataFrame(out, columns=["query_id", "unit", "part", "from_centre", "bars"])

        schema = "query_id long, unit array<double>, part int, from_centre double, bars map<int,double>"
        units = _stored(unit_vectors(queries))
        near = _stored(units.mapInPandas(first, schema))
        found = _stored(self._best(self._search(near, k), k))
        bars = found.groupBy("query_id", "collection").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar")).where(F.col("n") >= k)
        bars = bars.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("collection", "bar"))).alias("bars"))
        seen = near.groupBy("query_id").agg(F.collect_set("part").alias("seen"))
        open_ = units.withColumnRenamed("vec_id", "query_id").join(bars, "query_id", "left").join(seen, "query_id", "left").select("query_id", "unit", "bars", "seen")

        def rest(batches):
            for pdf in batches:
                out = []
                for query, unit, bars, seen, d in zip(pdf["query_id"], pdf["unit"], pdf["bars"], pdf["seen"], _distances(np.stack(pdf["unit"].to_numpy()), centres) if len(pdf) else []):
                    bars, seen = dict(bars) if bars is not None else {}, set(seen if seen is not None else [])
                    parts = set()
                    for part, c, _, radius in lists:
                        least = max(0.0, d[part] - radius - SLACK)
                        if part not in seen and 1 - least**2 / 2 >= bars.get(c, -2.0) - SLACK:
                            parts.add(part)
                    out += [(query, unit, part, float(d[part]), bars) for part in sorted(parts)]
                yield pd.DataFrame(out, columns=["query_id", "unit", "part", "from_centre", "bars"])

        more = open_.mapInPandas(rest, schema)
        return self._best(found.unionByName(self._search(more, k)), k)


def context(found: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """query_id, chunks, context: the texts of the neighbours in order of collection, then score, cut at ``n``, each under a numbered mark.

    ``found`` as a search with k = max(2, n // 3) gives it; ``texts``: vec_id, text.  A neighbour without a text is left out.
    """
    rows = found.join(texts, "vec_id").where("text IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("collection", F.desc("score"), "vec_id"))
    rows = rows.withColumn("_at", place).where(F.col("_at") <= n)  # at most n a query
    chunk = F.struct("_at", F.concat(F.lit("[Context "), F.col("_at").cast("string"), F.lit("] "), F.col("text")).alias("text"))
    out = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("chunks"), F.sort_array(F.collect_list(chunk)).alias("_c"))
    return out.select("query_id", "chunks", F.array_join(F.transform("_c", lambda c: c["text"]), "\n\n").alias("context"))


def per_collection(n: int) -> int:
    return max(2, n // 3)
