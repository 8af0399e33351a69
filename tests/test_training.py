"""Training over folds, on data with known answers."""

import datetime

import numpy as np
import pytest

from marketloom.operators.training import fold_auc, fold_rows, greedy, lifts, meta_report, meta_rows, stack, walk_forward
from marketloom.plans.models import learner
from marketloom.plans.training import bands

DAY = datetime.date(2020, 1, 1)


def days(i: int, n: int = 0):
    return DAY + datetime.timedelta(days=i + n)


def test_weights_count_in_every_fold(spark):
    """Rows of weight nought teach nothing: with them reversed, a learner still finds the rule of the others."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        for s, weight, sign in (("A", 1.0, 1), ("B", 0.0, -1)):
            x = float(rng.normal())
            rows.append((s, days(i), days(i, 1), x, float(sign * x > 0), 3.0 * sign * x, weight))
    df = spark.createDataFrame(rows, "symbol string, date date, t1 date, x double, y double, ret double, weight double")
    folds = fold_rows(df)
    for kind in ("logistic", "gbt"):
        got = walk_forward(folds, learner(kind), ["x"]).where("symbol = 'A'").collect()
        assert len(got) == 257 and np.mean([(r.p > 0.5) == (r.y > 0.5) for r in got]) > 0.95
    got = walk_forward(folds, learner("gbt_return"), ["x"], "pred").where("symbol = 'A'").collect()
    assert np.corrcoef([r.pred for r in got], [r.ret for r in got])[0, 1] > 0.9
    assert walk_forward(fold_rows(df.limit(0)), learner("gbt"), ["x"]).count() == 0


def test_selection_stops_without_a_gain():
    worth = {"a": 0.04, "b": 0.1, "c": 0.00005, "d": -0.1}
    tried = []

    def score(columns):
        tried.append(tuple(columns))
        gain = sum(worth.get(c, 0.0) for c in columns)
        return 0.5 + gain - (0.04 if {"a", "b"} <= set(columns) else 0.0)  # what a knows, b knows too

    assert lifts(score, ["base"], ["a", "b", "c", "d"]) == [(c, pytest.approx(worth[c])) for c in ("b", "a", "c", "d")]
    tried.clear()
    assert greedy(score, ["base"], ["d", "c", "b", "a"]) == [(1, "b", pytest.approx(0.6))]
    assert tried[0] == ("base",) and len(tried) == 1 + 4 + 3
    assert greedy(score, ["base"], []) == [] and greedy(lambda c: float("nan"), ["base"], ["a"]) == []


def test_out_of_fold_auc_tells_signal_from_noise(spark):
    rng = np.random.default_rng(6)
    rows = [("A", days(i), days(i, 1), float(a), float(b), float(a + 0.5 * e > 0)) for i, (a, b, e) in enumerate(rng.normal(size=(250, 3)))]
    score = fold_auc(spark.createDataFrame(rows, "symbol string, date date, t1 date, a double, b double, y double"), learner("logistic"))
    assert score(["a"]) > 0.9 > 0.65 > score(["b"])


def test_meta_labels_and_their_report(spark):
    first = spark.createDataFrame([(1, 1.0, 0.7), (1, 0.0, 0.7), (2, 0.0, 0.4), (2, 1.0, 0.5)], "fold int, y double, calibrated double")
    rows = meta_rows(first)
    assert [(r.primary_p, r.right) for r in rows.collect()] == [(0.7, 1.0), (0.7, 0.0), (0.4, 1.0), (0.5, 1.0)] and "fold" not in rows.columns
    scored = spark.createDataFrame([(0.5, 1.0), (0.55, 0.0), (0.58, 1.0), (0.2, 0.0)], "meta_p double, right double")
    got = {r.threshold: (r.coverage, r.precision) for r in meta_report(scored).collect()}
    assert got == {None: (1.0, 0.5), 0.5: (0.75, pytest.approx(2 / 3)), 0.55: (0.5, 0.5), 0.6: (0.0, None)}


def test_bands_by_scaled_residuals(spark):
    rows = [(0.01 * k, 0.0, 0.01) for k in range(1, 100)] + [(5.0, 0.0, 0.0), (5.0, 0.0, None), (None, 0.0, 0.01)]
    got = {r.alpha: r for r in bands(spark.createDataFrame(rows, "ret double, pred double, scale double")).collect()}
    u = np.arange(1, 100, dtype=float)
    for alpha, r in got.items():
        q = np.quantile(u, np.ceil(100 * (1 - alpha)) / 99, method="higher")
        assert r.q == pytest.approx(q) and r.coverage == pytest.approx((u <= q).mean()) and r.n == 99
    assert got[0.1].mae == pytest.approx(0.5) == got[0.1].naive_mae and not got[0.1].has_skill
    better = bands(spark.createDataFrame([(0.02, 0.01, 0.01)] * 30, "ret double, pred double, scale double")).collect()
    assert all(r.has_skill for r in better)


def test_stack_uses_experts_only_where_regimes_differ(spark):
    rng = np.random.default_rng(7)
    rows = {True: [], False: []}
    for i in range(1500):
        a, b, e = rng.normal(size=3)
        regime = ("trend", "chop")[i % 2]
        for differ in rows:
            y = float((-a if differ and regime == "chop" else a) + 0.3 * e > 0)
            rows[differ].append(("A", days(i), y, float(1 / (1 + np.exp(-b))), 0.5, float(a), regime, float(regime == "trend"), float(regime == "chop"), 0.0))
    kind = "symbol string, date date, y double, primary double, p2 double, a double, regime string, p_trend double, p_chop double, p_risk_off double"
    for differ in rows:
        out, report = stack(spark.createDataFrame(rows[differ], kind), ["primary", "p2", "a"], "primary", least=100)
        assert report["n_eval"] == 450 == out.count() and report["passes"] and report["use_experts"] == differ
        assert report["stack_auc"] > 0.75 and report["best_base"] == "primary"
        assert min(r.stack_p for r in out.collect()) >= 0 and max(r.stack_p for r in out.collect()) <= 1
    few = stack(spark.createDataFrame(rows[True], kind), ["primary", "p2", "a"], "primary", least=5000)[1]
    assert not few["use_experts"] and few["mixed_auc"] == few["one_auc"]
    late = spark.createDataFrame([r[:2] + (1.0,) + r[3:] for r in rows[True]], kind)
    assert stack(late, ["primary", "p2", "a"], "primary")[1] == {"n_eval": 0} and stack(late.limit(0), ["a"], "primary")[0].count() == 0


def test_split_bands_are_held_against_the_last_fold(spark):
    from marketloom.plans.training import split_bands

    rows = [(k, 0.0, (i % 100) / 100.0, 1.0) for k in (1, 2) for i in range(500)]
    rows += [(3, 0.0, (i % 100) / 50.0, 1.0) for i in range(500)] + [(3, 0.0, 1.0, 0.0), (3, None, 1.0, 1.0)]  # twice as wide in the last fold
    got = {r.alpha: r for r in split_bands(spark.createDataFrame(rows, "fold int, ret double, pred double, scale double")).collect()}
    assert abs(got[0.2].q - 0.8) < 0.02 and abs(got[0.2].coverage - 0.8) < 0.02 and got[0.2].n == 1000
    assert abs(got[0.2].held_out - 0.4) < 0.03 and abs(got[0.1].held_out - 0.45) < 0.03
