"""The training surface: return regressor and its bands, meta labels, feature choice, stacking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import r6
from ..operators.evaluation import conformal
from ..operators.training import fold_auc, fold_rows, greedy, lifts, meta_report, meta_rows, stack, stored, walk_forward
from ..registry import query
from .learning import calibrated, stored_bars
from .models import INPUTS, conditional_scale, features, learner, regimes
from .rules import has_skill

#: Columns that are always in, and those to choose from.
BASE, CANDIDATES = ["sma5", "sma20"], ["r1", "r5", "vol20"]


def out_of_fold_return(rows: DataFrame) -> DataFrame:
    """Test rows with ``pred``, a regressor's return over the horizon."""
    return walk_forward(fold_rows(rows), learner("gbt_return"), INPUTS, "pred")


@query("oof_return")
def oof_return(spark, sf_dir) -> DataFrame:
    got = out_of_fold_return(features(spark, sf_dir))
    return got.select("symbol", "date", "fold", r6(F.col("ret")).alias("ret"), r6(F.col("pred")).alias("pred"))


def bands(scored: DataFrame, alphas: tuple[float, ...] = (0.2, 0.1)) -> DataFrame:
    """Half-widths of return bands in units of ``scale``, from out-of-fold residuals (ret - pred), with coverage and the skill of ``pred``.

    Rows without a positive scale do not count.
    """
    ok = scored.where((F.col("scale") > 0) & F.col("ret").isNotNull() & F.col("pred").isNotNull())
    ok = stored(ok.select("ret", "pred", "scale", (F.abs(F.col("ret") - F.col("pred")) / F.greatest("scale", F.lit(1e-12))).alias("u")), "residuals")
    errors = ok.agg(F.avg(F.abs(F.col("ret") - F.col("pred"))).alias("mae"), F.avg(F.abs("ret")).alias("naive_mae"))
    out = conformal(ok, "u", list(alphas)).crossJoin(F.broadcast(errors))  # one row
    return out.select("alpha", "q", "coverage", "n", "mae", "naive_mae", has_skill(F.col("mae"), F.col("naive_mae")).alias("has_skill"))


@query("oof_conformal")
def oof_conformal(spark, sf_dir) -> DataFrame:
    """Bands around the regressor, scaled by the volatility that was forecast at the event."""
    stored_once = stored_bars(spark, sf_dir)
    b = bands(out_of_fold_return(features(spark, sf_dir, stored_once)).join(conditional_scale(spark, sf_dir, stored_once), ["symbol", "date"]))
    return b.select("alpha", *[r6(F.col(c)).alias(c) for c in ("q", "coverage")], "n", *[r6(F.col(c)).alias(c) for c in ("mae", "naive_mae")], "has_skill")


def split_bands(scored: DataFrame, alphas: tuple[float, ...] = (0.2, 0.1)) -> DataFrame:
    """Half-widths from the residuals of all folds but the last, and the coverage of the last fold's: alpha, q, n, coverage, held_out.

    ``coverage`` is that of the residuals that the widths were fitted to, by construction near 1 - alpha; ``held_out`` may miss it.
    """
    ok = scored.where((F.col("scale") > 0) & F.col("ret").isNotNull() & F.col("pred").isNotNull())
    ok = stored(ok.select("fold", (F.abs(F.col("ret") - F.col("pred")) / F.greatest("scale", F.lit(1e-12))).alias("u")), "split-residuals")
    last = ok.agg(F.max("fold")).first()[0]
    early, late = ok.where(F.col("fold") < F.lit(last)), ok.where(F.col("fold") == F.lit(last)).select("u")
    fitted = conformal(early, "u", list(alphas))  # a row per alpha
    held = late.crossJoin(F.broadcast(fitted.select("alpha", "q"))).groupBy("alpha").agg(F.avg((F.col("u") <= F.col("q")).cast("double")).alias("held_out"))
    return fitted.join(held, "alpha", "left").select("alpha", "q", "n", "coverage", "held_out")


@query("oof_conformal_split")
def oof_conformal_split(spark, sf_dir) -> DataFrame:
    """Bands fitted to the earlier folds and held against the last one."""
    stored_once = stored_bars(spark, sf_dir)
    b = split_bands(out_of_fold_return(features(spark, sf_dir, stored_once)).join(conditional_scale(spark, sf_dir, stored_once), ["symbol", "date"]))
    return b.select("alpha", *[r6(F.col(c)).alias(c) for c in ("q", "coverage", "held_out")], "n")


def out_of_fold_meta(rows: DataFrame, primary: DataFrame | None = None) -> DataFrame:
    """Test rows of the second model with ``primary_p`` (calibrated out of sample), ``right`` and ``meta_p``."""
    primary = primary if primary is not None else stored(walk_forward(fold_rows(rows), learner("gbt"), INPUTS), "primary")
    second = stored(meta_rows(calibrated(primary, y="y", p="p")), "meta-rows")  # its places are counted from two reads
    return walk_forward(fold_rows(second), learner("gbt_meta"), [*INPUTS, "primary_p"], "meta_p")


@query("oof_meta")
def oof_meta(spark, sf_dir) -> DataFrame:
    """Is the first model right?  Out-of-fold answers, from its features and its calibrated probability."""
    got = out_of_fold_meta(features(spark, sf_dir))
    return got.select("symbol", "date", "fold", r6(F.col("primary_p")).alias("primary_p"), F.col("right").cast("int").alias("right"), r6(F.col("meta_p")).alias("meta_p"))


@query("meta_precision")
def meta_precision(spark, sf_dir) -> DataFrame:
    """Precision of the calls that the second model lets through, against acting on all."""
    got = meta_report(stored(out_of_fold_meta(features(spark, sf_dir)), "meta"))
    return got.select("threshold", r6(F.col("coverage")).alias("coverage"), r6(F.col("precision")).alias("precision"))


@query("feature_lift")
def feature_lift(spark, sf_dir) -> DataFrame:
    """What each column adds by itself to the out-of-fold AUC of the base columns, refitted with it."""
    got = lifts(fold_auc(features(spark, sf_dir), learner("logistic")), BASE, CANDIDATES)
    return spark.createDataFrame([(c, v) for c, v in got], "added string, lift double").withColumn("lift", r6(F.col("lift")))


@query("greedy_features")
def greedy_features(spark, sf_dir) -> DataFrame:
    """Columns in the order in which forward selection takes them; no rows if none gains."""
    got = greedy(fold_auc(features(spark, sf_dir), learner("logistic")), BASE, CANDIDATES)
    rows = spark.createDataFrame([(0, ",".join(BASE), None), *got], "step int, added string, auc double")
    return rows.withColumn("auc", r6(F.col("auc")))


def signals(rows: DataFrame, regime: DataFrame) -> DataFrame:
    """Base signals of the events that all models have scored: primary (calibrated), p2, meta_p, pred, and the regime, by default the trend."""
    folds = fold_rows(rows)
    first = stored(walk_forward(folds, learner("gbt"), INPUTS), "primary")
    keys = ["symbol", "date"]
    meta = out_of_fold_meta(rows, first).select(*keys, F.col("primary_p").alias("primary"), "meta_p", "y")
    second = walk_forward(folds, learner("logistic"), INPUTS, "p2").select(*keys, "p2")
    size = walk_forward(folds, learner("gbt_return"), INPUTS, "pred").select(*keys, "pred")
    out = meta.join(second, keys).join(size, keys).join(regime, keys, "left")
    third = [F.coalesce(F.col(f"p_{r}"), F.lit(1 / 3)).alias(f"p_{r}") for r in ("trend", "chop", "risk_off")]
    return out.select(*keys, "y", "primary", "p2", "meta_p", "pred", F.coalesce("regime", F.lit("trend")).alias("regime"), *third)


@query("stack_report")
def stack_report(spark, sf_dir) -> DataFrame:
    """Held-out figures of the stack, and whether it has earned its place; NULL where the later rows have one outcome only."""
    b = stored_bars(spark, sf_dir)
    _, r = stack(signals(features(spark, sf_dir, b), regimes(spark, sf_dir, b)), ["primary", "p2", "meta_p", "pred"], "primary")
    kinds = {"n_eval": "long", "stack_auc": "double", "one_auc": "double", "mixed_auc": "double", "use_experts": "boolean", "best_base": "string", "best_auc": "double", "passes": "boolean"}
    one = spark.createDataFrame([tuple(r.get(k) for k in kinds)], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    return one.select(*[r6(F.col(k)).alias(k) if t == "double" else k for k, t in kinds.items()])
