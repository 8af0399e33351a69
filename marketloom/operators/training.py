"""Training over walk-forward folds: out-of-fold scores, meta labels, feature choice and stacking.

Models come from ``pyspark.ml``, so fitting is distributed; the driver holds models, fold bounds and single figures only.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch
from .evaluation import auc
from .labels import pooled_position, purged_folds

FOLDS = 6
#: Fits that run beside each other; each is a Spark job of its own.
PARALLEL = 3
REGIMES = ("trend", "chop", "risk_off")
#: Gain in AUC under which a feature or a stack is not worth having.
MARGIN = 1e-4


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read again: later steps neither repeat it nor hold it in memory."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_rows(rows: DataFrame, k: int = FOLDS) -> DataFrame:
    """Rows (symbol, date, t1 and more) with ``fold`` and ``role`` for ``k`` purged walk-forward folds; the last fold reaches the last row."""
    return purged_folds(stored(pooled_position(rows, "date", ["symbol"]), "fold-rows"), k=k, whole=True)


def _fit(learner, rows: DataFrame, inputs: list[str]):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    if "weight" in rows.columns:
        learner = learner.copy({learner.weightCol: "weight"})
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="_x"), learner]).fit(rows)


def _scored(model, rows: DataFrame, output: str) -> DataFrame:
    """``rows`` with the model's probability of 1, or what it predicts if it is a regressor."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows)
    value = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.select(*rows.columns, value.alias(output))


def walk_forward(folds: DataFrame, learner, inputs: list[str], output: str = "p") -> DataFrame:
    """Test rows of every fold, scored by ``learner`` (features in ``_x``) as fitted to the fold's training rows.

    A fold without training rows is left out.  A column ``weight`` weighs the training rows.
    """
    trained = sorted(r["fold"] for r in folds.where("role = 'train'").select("fold").distinct().collect())  # a row per fold
    with ThreadPool(PARALLEL) as pool:
        models = pool.map(lambda k: _fit(learner, folds.where((F.col("fold") == k) & (F.col("role") == "train")), inputs), trained)
    tested = folds.where("role = 'test'")
    out = tested.where("false").withColumn(output, F.lit(0.0))
    for k, model in zip(trained, models):
        out = out.unionByName(_scored(model, tested.where(F.col("fold") == k), output))
    return out.drop("role", "pos")


def _auc(df: DataFrame, y: str, p: str) -> float:
    got = auc(df, y, p).first()["auc"]
    return float("nan") if got is None else float(got)


def fold_auc(rows: DataFrame, learner, y: str = "y") -> Callable[[list[str]], float]:
    """A function from input columns to the AUC of their out-of-fold scores, on the same folds each time."""
    folds = fold_rows(rows)
    return lambda inputs: _auc(walk_forward(folds, learner, inputs), y, "p")


def lifts(score: Callable[[list[str]], float], base: list[str], candidates: list[str]) -> list[tuple[str, float]]:
    """What each candidate adds to the score of ``base`` by itself, largest first; names break ties."""
    start = score(base)
    return sorted(((c, score([*base, c]) - start) for c in candidates), key=lambda x: (-x[1], x[0]))


def greedy(score: Callable[[list[str]], float], base: list[str], candidates: list[str], margin: float = MARGIN) -> list[tuple[int, str, float]]:
    """Forward selection: (step, column, score) of the best column of each step, until none gains more than ``margin``."""
    chosen: list[tuple[int, str, float]] = []
    current, left = score(base), sorted(candidates)
    while left:
        have = [*base, *[c for _, c, _ in chosen]]
        best, name = max(((score([*have, c]), c) for c in left), key=lambda x: x[0])
        if not best > current + margin:
            break
        chosen.append((len(chosen) + 1, name, best))
        left.remove(name)
        current = best
    return chosen


def block_ablation(rows: DataFrame, learner, blocks: dict[str, list[str]], y: str = "y") -> list[tuple[str, int, float, float, float]]:
    """What each block of columns is worth: (block, columns, AUC with all blocks, AUC without it, difference), in the order given.

    All scores are on the same rows (those with every column of every block) and the same folds, which are stored once; only the columns that
    the learner is given differ.
    """
    every = [c for names in blocks.values() for c in names]
    score = fold_auc(rows.dropna(subset=every), learner, y)
    whole = score(every)
    out = []
    for name, own in blocks.items():
        rest = [c for c in every if c not in own]
        without = score(rest) if rest else 0.5
        out.append((name, len(own), whole, without, whole - without))
    return out


def meta_rows(primary: DataFrame, y: str = "y", p: str = "calibrated") -> DataFrame:
    """Rows for a second model that says whether to act on the first: its probability ``primary_p``, and ``right`` = 1 where it called the direction."""
    call = (F.col(p) >= 0.5).cast("double")
    return primary.withColumn("primary_p", F.col(p)).withColumn("right", (call == F.col(y)).cast("double")).drop("fold")


def meta_report(scored: DataFrame, p: str = "meta_p", right: str = "right", thresholds: tuple[float, ...] = (0.5, 0.55, 0.6)) -> DataFrame:
    """Per threshold the share of calls acted on and how many of these are right; the row with threshold NULL acts on all."""
    act = [(None, F.lit(True)), *[(t, F.col(p) >= t) for t in thresholds]]
    sums = scored.agg(*[f for i, (_, on) in enumerate(act) for f in (F.avg(on.cast("double")).alias(f"c{i}"), F.avg(F.when(on, F.col(right))).alias(f"p{i}"))])
    rows = [F.struct(F.lit(t).cast("double").alias("threshold"), F.col(f"c{i}").alias("coverage"), F.col(f"p{i}").alias("precision")) for i, (t, _) in enumerate(act)]
    return sums.select(F.inline(F.array(*rows)))


def stack(rows: DataFrame, signals: list[str], primary: str, y: str = "y", share: float = 0.7, least: int = 500, shrink: float = 0.5) -> tuple[DataFrame, dict]:
    """A logistic stack over base signals, fitted to the early ``share`` of the rows and judged on the later ones.

    Rows need symbol, date, ``signals``, ``regime`` and ``p_<regime>``.  One model serves all rows; experts of a regime (those with
    ``least`` early rows and both outcomes) are mixed by the regime's probabilities and are used only if they rank the later rows
    better.  The result is drawn to ``primary`` by ``shrink`` and passes if it ranks better than every base signal in ``primary`` and
    ``p2``.  Returns the later rows with ``stack_p``, and the figures.  Without early or later rows of both outcomes nothing is scored.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = stored(pooled_position(stored(rows, "stack-signals"), "date", ["symbol"]), "stack-rows")  # places are counted from two reads
    n = rows.count()
    early = F.col("pos") < int(n * share)
    kinds = {(r["early"], r["regime"]): (r["n"], r["ones"]) for r in rows.groupBy(early.alias("early"), "regime").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("ones")).collect()}  # two rows a regime

    def both(part: bool) -> bool:
        counts = [v for (e, _), v in kinds.items() if e == part]
        return 0 < sum(o for _, o in counts) < sum(c for c, _ in counts)

    if not (both(True) and both(False)):
        return rows.where("false").drop("pos").withColumn("stack_p", F.lit(0.0)), {"n_eval": 0}
    flat = VectorAssembler(inputCols=signals, outputCol="_raw").transform(rows)
    scaler = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(flat.where(early))
    scaled = scaler.transform(flat).drop("_raw")

    def fitted(part: DataFrame, size: int):  # a unit penalty on the sum of losses
        return LogisticRegression(featuresCol="_x", labelCol=y, regParam=1.0 / size, elasticNetParam=0.0, standardization=False, maxIter=100).fit(part)

    late = scaled.where(~early)
    one = fitted(scaled.where(early), sum(c for (e, _), (c, _) in kinds.items() if e))
    experts = {r: fitted(scaled.where(early & (F.col("regime") == r)), kinds[True, r][0]) for r in REGIMES if (True, r) in kinds and kinds[True, r][0] >= least and 0 < kinds[True, r][1] < kinds[True, r][0]}
    late = _scored(one, late, "_one")
    for r in REGIMES:
        late = _scored(experts[r], late, f"_{r}") if r in experts else late.withColumn(f"_{r}", F.col("_one"))
    weight = {r: F.greatest(F.coalesce(F.col(f"p_{r}"), F.lit(0.0)), F.lit(0.0)) for r in REGIMES}
    total = sum((weight[r] for r in REGIMES), F.lit(0.0))
    mixed = sum((weight[r] * F.col(f"_{r}") for r in REGIMES), F.lit(0.0))
    late = stored(late.drop("_x").withColumn("_mixed", F.when(total > 1e-9, mixed / total).otherwise(F.col("_one"))), "stack-scores")
    one_auc, mixed_auc = _auc(late, y, "_one"), _auc(late, y, "_mixed")
    use_experts = bool(mixed_auc > one_auc + MARGIN)
    raw = F.col("_mixed" if use_experts else "_one")
    out = late.withColumn("stack_p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - shrink) * raw + shrink * F.col(primary))))
    base = {s: _auc(out, y, s) for s in (primary, "p2")}
    stack_auc, best = _auc(out, y, "stack_p"), max(base, key=lambda s: base[s])
    report = {"n_eval": sum(c for (e, _), (c, _) in kinds.items() if not e), "stack_auc": stack_auc, "one_auc": one_auc, "mixed_auc": mixed_auc, "use_experts": use_experts, "best_base": best, "best_auc": base[best], "passes": bool(stack_auc > base[best] + MARGIN)}
    return out.drop("pos", "_one", "_mixed", *[f"_{r}" for r in REGIMES]), report
