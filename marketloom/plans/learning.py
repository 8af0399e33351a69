"""Labels, cross-validation and the evaluation of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import r6
from ..operators import windows as w
from ..operators.evaluation import EDGES, auc, conformal, decile, ece, with_rank
from ..operators.labels import pooled_position, purged_folds, triple_barrier, uniqueness
from ..operators.training import stored
from ..registry import query
from ..sources.logical import bars, outcomes, predictions, twin, verdicts

_W = "(PARTITION BY symbol ORDER BY date"
_H = 5
_VOL = f"SELECT symbol, date, close, CASE WHEN count(r) OVER {_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN stddev_samp(r) OVER {_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol FROM (SELECT *, ln(close / lag(close) OVER {_W})) AS r FROM bars)"
_LEADS = f"SELECT *, {', '.join(f'lead(close, {j}) OVER {_W}) AS c{j}, lead(date, {j}) OVER {_W}) AS d{j}' for j in range(1, _H + 1))} FROM v"
_HIT = "CASE " + " ".join(f"WHEN c{j} / close - 1 >= vol THEN {{pt{j}}} WHEN c{j} / close - 1 <= -vol THEN {{sl{j}}}" for j in range(1, _H + 1)) + " " + " ".join(f"WHEN c{j} IS NOT NULL THEN {{to{j}}}" for j in range(_H, 0, -1)) + " END"


def _hit(kind) -> str:
    return _HIT.format(**{f"{k}{j}": kind(k, j) for k in ("pt", "sl", "to") for j in range(1, _H + 1)})


_EVENTS = (("v", _VOL), ("ld", _LEADS), ("ev", f"SELECT symbol, date, {_hit(lambda k, j: repr('timeout' if k == 'to' else k))} AS barrier, {_hit(lambda k, j: f'c{j} / close - 1')} AS ret, {_hit(lambda k, j: f'd{j}')} AS t1 FROM ld WHERE c1 IS NOT NULL AND vol > 0"))


def stored_bars(spark, sf_dir) -> DataFrame:
    """The bars, written once for a query that needs them at several places; each of these would read and group all lines again."""
    return stored(bars(spark, sf_dir), "bars")


def events(spark, sf_dir, b: DataFrame | None = None) -> DataFrame:
    """Labelled events of the bars ``b``, by default those of the tables."""
    b = (bars(spark, sf_dir) if b is None else b).withColumn("r", w.log_return(F.col("close")))
    return triple_barrier(b.select("symbol", "date", "close", w.rstd(F.col("r"), 20).alias("vol")), "vol", _H).select("symbol", "date", "barrier", "ret", "t1", "label")


@query("triple_barrier", twin("SELECT symbol, date, barrier, round(ret, 6) AS ret, t1, sign(ret)::INT AS label FROM ev", *_EVENTS))
def triple_barrier_q(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).withColumn("ret", r6(F.col("ret")))


@query("label_distribution", twin("SELECT barrier, count(*)::BIGINT AS n, round(avg(ret), 6) AS mean_ret FROM ev GROUP BY barrier", *_EVENTS))
def label_distribution(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).groupBy("barrier").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ret")).alias("mean_ret"))


_POS = ("ps", f"SELECT symbol, date, row_number() OVER {_W}) AS pos FROM bars")
_CELLS = (_POS, ("sp", "SELECT e.symbol, e.date, a.pos AS a, b.pos AS b FROM ev e JOIN ps a ON a.symbol = e.symbol AND a.date = e.date JOIN ps b ON b.symbol = e.symbol AND b.date = e.t1"), ("ce", "SELECT symbol, date, unnest(range(a, b + 1)) AS pos FROM sp"))


@query("uniqueness", twin("SELECT symbol, date, round(u / avg(u) OVER (PARTITION BY symbol), 6) AS weight FROM (SELECT ce.symbol, ce.date, avg(1 / n::DOUBLE) AS u FROM ce JOIN (SELECT symbol, pos, count(*) AS n FROM ce GROUP BY ALL) c ON c.symbol = ce.symbol AND c.pos = ce.pos GROUP BY ALL)", *_EVENTS, *_CELLS))
def uniqueness_q(spark, sf_dir) -> DataFrame:
    b = stored_bars(spark, sf_dir)
    return uniqueness(events(spark, sf_dir, b), b.select("symbol", "date")).withColumn("weight", r6(F.col("weight")))


@query("interval_overlap", twin("SELECT symbol, pos::INT AS pos, count(*)::BIGINT AS open_events FROM ce GROUP BY ALL", *_EVENTS, *_CELLS))
def interval_overlap(spark, sf_dir) -> DataFrame:
    """How many labelled events are open at each bar."""
    b = stored_bars(spark, sf_dir)
    at = b.select("symbol", "date", F.row_number().over(w.by()).alias("pos"))
    e = events(spark, sf_dir, b).select("symbol", "date", "t1")
    spans = e.join(at.withColumnRenamed("pos", "a"), ["symbol", "date"]).join(at.select("symbol", F.col("date").alias("t1"), F.col("pos").alias("b")), ["symbol", "t1"])
    return spans.select("symbol", F.explode(F.sequence("a", "b")).alias("pos")).groupBy("symbol", "pos").agg(F.count(F.lit(1)).alias("open_events"))


_FOLDS = (("po", "SELECT symbol, date, t1, row_number() OVER (ORDER BY date, symbol) - 1 AS pos FROM ev"), ("fo", "SELECT f AS fold, f * s AS a, CASE WHEN f = 5 THEN n ELSE (f + 1) * s END AS b, greatest(0, f * s - 7) AS c FROM (SELECT max(pos) + 1 AS n, (max(pos) + 1) // 6 AS s FROM po), (SELECT unnest(range(1, 6)) AS f)"),
    ("fd", "SELECT fold, CASE WHEN p.pos >= a AND p.pos < b THEN 'test' WHEN p.pos < a AND p.t1 < q.date THEN 'train' END AS role, p.* FROM fo JOIN po q ON q.pos = fo.c CROSS JOIN po p"))


def _pooled(spark, sf_dir) -> DataFrame:
    return pooled_position(events(spark, sf_dir).select("symbol", "date", "t1", "ret"), "date", ["symbol"])


@query("purged_folds", twin("SELECT fold::INT AS fold, role, count(*)::BIGINT AS n, min(date) AS first_date, max(date) AS last_date, max(t1) AS last_t1 FROM fd WHERE role IS NOT NULL GROUP BY ALL", *_EVENTS, *_FOLDS))
def purged_folds_q(spark, sf_dir) -> DataFrame:
    return purged_folds(_pooled(spark, sf_dir), whole=True).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("t1").alias("last_t1"))


@query("purge_overlap_zero", twin("SELECT t.fold::INT AS fold, count(*) FILTER (WHERE r.last_t1 >= t.first_date)::BIGINT AS overlaps FROM (SELECT fold, min(date) AS first_date FROM fd WHERE role = 'test' GROUP BY fold) t JOIN (SELECT fold, max(t1) AS last_t1 FROM fd WHERE role = 'train' GROUP BY fold) r ON r.fold = t.fold GROUP BY ALL", *_EVENTS, *_FOLDS))
def purge_overlap_zero(spark, sf_dir) -> DataFrame:
    """Training spans that reach into the test block: none."""
    f = purged_folds(_pooled(spark, sf_dir), whole=True).groupBy("fold").agg(F.min(F.when(F.col("role") == "test", F.col("date"))).alias("first_date"), F.max(F.when(F.col("role") == "train", F.col("t1"))).alias("last_t1"))
    return f.where("last_t1 is not null").select("fold", (F.col("last_t1") >= F.col("first_date")).cast("long").alias("overlaps"))


@query("daily_vol", twin("""SELECT symbol, date, CASE WHEN n >= 20 THEN round(sqrt(v * sw * sw / nullif(sw * sw - sw2, 0)), 6) END AS ew_vol FROM (
    SELECT symbol, date, n, sw, sw2, sum(wt * (x - mu) * (x - mu)) / sw AS v FROM (SELECT *, sum(wt * x) OVER g / sum(wt) OVER g AS mu, sum(wt) OVER g AS sw, sum(wt * wt) OVER g AS sw2, count(*) OVER g AS n FROM (
      SELECT b.symbol, b.date, a.x, pow(1 - 2 / 21::DOUBLE, b.rn - a.rn) AS wt FROM rr a JOIN rr b ON a.symbol = b.symbol AND a.rn <= b.rn WHERE a.x IS NOT NULL) WINDOW g AS (PARTITION BY symbol, date)) GROUP BY symbol, date, n, sw, sw2)""",
    ("rr", f"SELECT symbol, date, ln(close / lag(close) OVER {_W})) AS x, row_number() OVER {_W}) AS rn FROM bars")))
def daily_vol(spark, sf_dir) -> DataFrame:
    """Exponentially weighted standard deviation of log returns (span 20, bias-corrected), one symbol's series per group."""
    b = bars(spark, sf_dir).select("symbol", "date", w.log_return(F.col("close")).alias("x"))

    def run(pdf):
        pdf = pdf.sort_values("date")
        return pdf.assign(ew_vol=pdf["x"].ewm(span=20, min_periods=20).std())[["symbol", "date", "ew_vol"]]

    out = b.groupBy("symbol").applyInPandas(run, "symbol string, date date, ew_vol double").where(F.col("date").isNotNull())
    first = b.where("x is not null").select("symbol", "date")
    return out.join(first, ["symbol", "date"]).select("symbol", "date", r6(F.when(~F.isnan("ew_vol"), F.col("ew_vol"))).alias("ew_vol"))


_RES = ("res", "SELECT p.*, o.actual_return, o.correct, o.in_band, (prob_up - 0.5::DOUBLE) * 0.2::DOUBLE AS pred FROM predictions p JOIN outcomes o ON o.prediction_id = p.id")


def resolved(spark, sf_dir) -> DataFrame:
    p, o = predictions(spark, sf_dir), outcomes(spark, sf_dir)
    return p.join(o, p["id"] == o["prediction_id"]).drop("prediction_id").withColumn("pred", (F.col("prob_up") - 0.5) * 0.2)


@query("auc", twin("SELECT round(sum(pos * (below + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY prob_up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT prob_up, sum(correct) AS pos, sum(1 - correct) AS neg FROM res GROUP BY prob_up))", _RES))
def auc_q(spark, sf_dir) -> DataFrame:
    return auc(resolved(spark, sf_dir), "correct", "prob_up").withColumn("auc", r6(F.col("auc")))


_BIN = "(" + " + ".join(f"(p >= {e!r}::DOUBLE)::INT" for e in EDGES) + " - 1)"


def _ece_sql(p: str) -> str:
    return f"SELECT round(sum(k * gap) / max(n), 6) AS ece, max(n)::BIGINT AS n FROM (SELECT count(*) AS k, abs(avg(p) - avg(correct)) AS gap FROM (SELECT {p} AS p, correct FROM res) WHERE p < 1 GROUP BY {_BIN}), (SELECT count(*) AS n FROM res)"


@query("ece", twin(_ece_sql("meta_prob"), _RES))
def ece_q(spark, sf_dir) -> DataFrame:
    return ece(resolved(spark, sf_dir), "correct", "meta_prob").withColumn("ece", r6(F.col("ece")))


@query("ece_per_fold", twin(f"SELECT fold, round(sum(k * gap) / sum(k), 6) AS ece, sum(k)::BIGINT AS n FROM (SELECT fold, count(*) AS k, abs(avg(p) - avg(correct)) AS gap FROM (SELECT fold, meta_prob AS p, correct FROM res) WHERE p < 1 GROUP BY fold, {_BIN}) GROUP BY fold HAVING sum(k) >= 100", _RES))
def ece_per_fold(spark, sf_dir) -> DataFrame:
    bins = resolved(spark, sf_dir).where("meta_prob < 1").groupBy("fold", decile(F.col("meta_prob")).alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.abs(F.avg("meta_prob") - F.avg("correct")).alias("gap"))
    return bins.groupBy("fold").agg(r6(F.sum(F.col("k") * F.col("gap")) / F.sum("k")).alias("ece"), F.sum("k").alias("n")).where("n >= 100")


@query("confusion_f1", twin("SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM (SELECT sum((y = 1 AND h = 1)::INT) AS tp, sum((y = 0 AND h = 1)::INT) AS fp, sum((y = 1 AND h = 0)::INT) AS fn, sum((y = 0 AND h = 0)::INT) AS tn FROM (SELECT correct AS y, (prob_up >= 0.5)::INT AS h FROM res))", _RES))
def confusion_f1(spark, sf_dir) -> DataFrame:
    y, h = F.col("correct"), (F.col("prob_up") >= 0.5).cast("int")
    cell = lambda a, b: F.sum(((y == a) & (h == b)).cast("int"))
    c = resolved(spark, sf_dir).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    return c.select("*", r6((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"), r6(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("f1"))


@query("baselines", twin("SELECT round(avg((actual_return > 0)::INT), 6) AS always_up, round(greatest(avg((actual_return > 0)::INT), 1 - avg((actual_return > 0)::INT)), 6) AS majority, round(avg((s = b)::INT) FILTER (WHERE b IS NOT NULL), 6) AS persistence FROM (SELECT *, actual_return > 0 AS s, lag(actual_return > 0) OVER (PARTITION BY symbol ORDER BY generated_at) AS b FROM res)", _RES))
def baselines(spark, sf_dir) -> DataFrame:
    up = (F.col("actual_return") > 0).cast("int")
    b = resolved(spark, sf_dir).select(up.alias("up"), F.lag(up).over(Window.partitionBy("symbol").orderBy("generated_at")).alias("before"))
    return b.agg(r6(F.avg("up")).alias("always_up"), r6(F.greatest(F.avg("up"), 1 - F.avg("up"))).alias("majority"), r6(F.avg(F.when(F.col("before").isNotNull(), (F.col("up") == F.col("before")).cast("int")))).alias("persistence"))


@query("threshold_precision", twin("SELECT t AS threshold, round(avg(correct) FILTER (WHERE meta_prob >= t), 6) AS precision, round(avg((meta_prob >= t)::INT), 6) AS coverage FROM res, (SELECT unnest([0.5::DOUBLE, 0.55::DOUBLE, 0.6::DOUBLE]) AS t) GROUP BY t", _RES))
def threshold_precision(spark, sf_dir) -> DataFrame:
    r = resolved(spark, sf_dir).select("correct", "meta_prob", F.explode(F.array(F.lit(0.5), F.lit(0.55), F.lit(0.6))).alias("threshold"))
    act = F.col("meta_prob") >= F.col("threshold")
    return r.groupBy("threshold").agg(r6(F.avg(F.when(act, F.col("correct")))).alias("precision"), r6(F.avg(act.cast("int"))).alias("coverage"))


@query("selective_accuracy", twin("SELECT f AS frac, count(*)::BIGINT AS n, round(avg(correct), 6) AS accuracy FROM (SELECT correct, row_number() OVER (ORDER BY abs(prob_up - 0.5::DOUBLE) DESC, id) AS rk, count(*) OVER () AS n FROM res), (SELECT unnest([1::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE, 0.1::DOUBLE, 0.05::DOUBLE]) AS f) WHERE rk <= greatest(50, floor(n * f)) GROUP BY f", _RES))
def selective_accuracy(spark, sf_dir) -> DataFrame:
    r = resolved(spark, sf_dir).select("id", "correct", F.abs(F.col("prob_up") - 0.5).alias("sure"))
    n = r.agg(F.count(F.lit(1)).alias("n"))
    ranked = with_rank(r, (0.5 - F.col("sure")) / 0.501, [F.desc("sure"), "id"]).crossJoin(F.broadcast(n))  # one row
    ranked = ranked.withColumn("frac", F.explode(F.array(*[F.lit(f) for f in (1.0, 0.5, 0.25, 0.1, 0.05)]))).where(F.col("rank") <= F.greatest(F.lit(50), F.floor(F.col("n") * F.col("frac"))))
    return ranked.groupBy("frac").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("correct")).alias("accuracy"))


@query("calibration_live", twin("SELECT least(99, greatest(0, confidence)) // 10 AS bucket, round((least(99, greatest(0, confidence)) // 10 + 0.5::DOUBLE) / 10, 6) AS stated, round(avg(correct), 6) AS realized, count(*)::BIGINT AS n FROM res GROUP BY ALL", _RES))
def calibration_live(spark, sf_dir) -> DataFrame:
    bucket = F.expr("cast(least(99, greatest(0, confidence)) div 10 as int)")
    r = resolved(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(r6(F.avg("correct")).alias("realized"), F.count(F.lit(1)).alias("n"))
    return r.select("bucket", r6((F.col("bucket") + 0.5) / 10).alias("stated"), "realized", "n")


@query("calibration_meta", twin("SELECT least(9, floor(meta_prob * 10))::INT AS bucket, round(avg(meta_prob), 6) AS stated, round(avg(correct), 6) AS realized, count(*)::BIGINT AS n FROM res GROUP BY ALL", _RES))
def calibration_meta(spark, sf_dir) -> DataFrame:
    return resolved(spark, sf_dir).groupBy(F.least(F.lit(9), F.floor(F.col("meta_prob") * 10)).cast("int").alias("bucket")).agg(r6(F.avg("meta_prob")).alias("stated"), r6(F.avg("correct")).alias("realized"), F.count(F.lit(1)).alias("n"))


@query("point_report", twin("""SELECT count(*)::BIGINT AS n, round(avg(e), 6) AS mae, round(avg(a), 6) AS naive_mae, round(1 - avg(e) / nullif(avg(a), 0), 6) AS skill, round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(e, 0.5), 6) AS median_ae, round(avg((e <= 0.02::DOUBLE)::INT), 6) AS within,
    round(avg((sign(pred) = sign(actual_return))::INT), 6) AS direction, round(avg((actual_return BETWEEN pred - 0.05::DOUBLE AND pred + 0.05::DOUBLE)::INT), 6) AS coverage FROM (SELECT *, abs(pred - actual_return) AS e, abs(actual_return) AS a FROM res)""", _RES))
def point_report(spark, sf_dir) -> DataFrame:
    r = resolved(spark, sf_dir).select("pred", "actual_return", F.abs(F.col("pred") - F.col("actual_return")).alias("e"), F.abs("actual_return").alias("a"))
    share = lambda c: r6(F.avg(c.cast("int")))
    return r.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("e")).alias("mae"), r6(F.avg("a")).alias("naive_mae"), r6(1 - F.avg("e") / F.nullif(F.avg("a"), F.lit(0.0))).alias("skill"), r6(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse"), r6(F.percentile("e", 0.5)).alias("median_ae"),
        share(F.col("e") <= 0.02).alias("within"), share(F.signum("pred") == F.signum("actual_return")).alias("direction"), share(F.col("actual_return").between(F.col("pred") - 0.05, F.col("pred") + 0.05)).alias("coverage"))


@query("conformal", twin("""SELECT alpha, round(q, 6) AS q, round(avg((s <= q)::INT), 6) AS coverage, count(*)::BIGINT AS n FROM (SELECT alpha, CASE WHEN lv > 1 THEN 'inf'::DOUBLE ELSE list_sort(l)[ceil(lv * (n - 1))::INT + 1] END AS q FROM
    (SELECT alpha, l, n, ceil((n + 1) * (1 - alpha)) / n AS lv FROM (SELECT list(s) AS l, count(*) AS n FROM sc), (SELECT unnest([0.2::DOUBLE, 0.1::DOUBLE]) AS alpha))), sc GROUP BY ALL""", _RES, ("sc", "SELECT abs(pred - actual_return) AS s FROM res")))
def conformal_q(spark, sf_dir) -> DataFrame:
    s = resolved(spark, sf_dir).select(F.abs(F.col("pred") - F.col("actual_return")).alias("s"))
    return conformal(s, "s", [0.2, 0.1]).select("alpha", r6(F.col("q")).alias("q"), r6(F.col("coverage")).alias("coverage"), "n")


@query("multiclass_report", twin("""SELECT c AS class, count(*) FILTER (WHERE g = c)::BIGINT AS support, round(count(*) FILTER (WHERE g = c AND h = c) / nullif(count(*) FILTER (WHERE h = c), 0)::DOUBLE, 6) AS precision, round(count(*) FILTER (WHERE g = c AND h = c) / nullif(count(*) FILTER (WHERE g = c), 0)::DOUBLE, 6) AS recall
    FROM (SELECT CASE label WHEN 'agree' THEN 'bullish' WHEN 'veto' THEN 'bearish' ELSE 'neutral' END AS g, CASE WHEN llm_confidence > 60 THEN 'bullish' WHEN llm_confidence < 30 THEN 'bearish' ELSE sentiment END AS h FROM verdicts), (SELECT unnest(['bullish', 'bearish', 'neutral']) AS c) GROUP BY c"""))
def multiclass_report(spark, sf_dir) -> DataFrame:
    v = verdicts(spark, sf_dir).select(F.when(F.col("label") == "agree", "bullish").when(F.col("label") == "veto", "bearish").otherwise("neutral").alias("g"), F.when(F.col("llm_confidence") > 60, "bullish").when(F.col("llm_confidence") < 30, "bearish").otherwise(F.col("sentiment")).alias("h"))
    v = v.withColumn("class", F.explode(F.array(F.lit("bullish"), F.lit("bearish"), F.lit("neutral"))))
    gold, pred = (F.col("g") == F.col("class")).cast("int"), (F.col("h") == F.col("class")).cast("int")
    c = v.groupBy("class").agg(F.sum(gold).alias("support"), F.sum(pred).alias("p"), F.sum(gold * pred).alias("tp"))
    return c.select("class", "support", r6(F.try_divide("tp", "p")).alias("precision"), r6(F.try_divide("tp", "support")).alias("recall"))


@query("drift_metrics", twin(f"SELECT n, round(acc, 6) AS accuracy, ece, n >= 200 AND (acc < 0.48::DOUBLE OR ece > 0.1::DOUBLE) AS drift FROM (SELECT avg(correct) AS acc FROM res), ({_ece_sql('confidence / 100::DOUBLE')})", _RES))
def drift_metrics(spark, sf_dir) -> DataFrame:
    r = resolved(spark, sf_dir).withColumn("p", F.col("confidence") / 100)
    out = r.agg(F.avg("correct").alias("acc")).crossJoin(ece(r, "correct", "p"))  # one row each
    return out.select("n", r6(F.col("acc")).alias("accuracy"), r6(F.col("ece")).alias("ece"), ((F.col("n") >= 200) & ((F.col("acc") < 0.48) | (F.col("ece") > 0.1))).alias("drift"))


@query("band_hit_60", twin("SELECT symbol, count(*)::BIGINT AS n, round(avg(in_band), 6) AS hit FROM (SELECT symbol, in_band, row_number() OVER (PARTITION BY symbol ORDER BY generated_at DESC, id DESC) AS k FROM res WHERE in_band IS NOT NULL) WHERE k <= 60 GROUP BY symbol", _RES))
def band_hit_60(spark, sf_dir) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("generated_at"), F.desc("id")))
    return resolved(spark, sf_dir).where("in_band is not null").withColumn("k", k).where("k <= 60").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("in_band")).alias("hit"))


@query("feature_leak_corr", twin("SELECT round(corr(prob_up, meta_prob), 6) AS p_corr, round(corr(prob_up, actual_return), 6) AS leak FROM res", _RES))
def feature_leak_corr(spark, sf_dir) -> DataFrame:
    return resolved(spark, sf_dir).agg(r6(F.corr("prob_up", "meta_prob")).alias("p_corr"), r6(F.corr("prob_up", "actual_return")).alias("leak"))


@query("like_for_like", twin("SELECT count(*)::BIGINT AS n, round(avg((a = correct)::INT), 6) AS first_hit, round(avg((b = correct)::INT), 6) AS second_hit FROM (SELECT x.id, (x.prob_up >= 0.5)::INT AS a, (y.meta_prob >= 0.5)::INT AS b, x.correct FROM res x JOIN res y ON x.id = y.id WHERE x.fold >= 1 AND y.regime <> 'chop')", _RES))
def like_for_like(spark, sf_dir) -> DataFrame:
    """Two models compared on the rows that both have scored."""
    r = resolved(spark, sf_dir)
    a = r.where("fold >= 1").select("id", "correct", (F.col("prob_up") >= 0.5).cast("int").alias("a"))
    b = r.where("regime <> 'chop'").select("id", (F.col("meta_prob") >= 0.5).cast("int").alias("b"))
    hit = lambda c: r6(F.avg((F.col(c) == F.col("correct")).cast("int")))
    return a.join(b, "id").agg(F.count(F.lit(1)).alias("n"), hit("a").alias("first_hit"), hit("b").alias("second_hit"))


def calibrated(r: DataFrame, y: str = "correct", p: str = "meta_prob", least: int = 100) -> DataFrame:
    """Rows of each fold with ``calibrated``, by an isotonic fit on the folds before it; folds with fewer than ``least`` rows before them are left out."""
    from pyspark.ml.regression import IsotonicRegression

    sizes = {x["fold"]: x["count"] for x in r.groupBy("fold").count().collect()}  # a row per fold
    out = r.where("false").withColumn("calibrated", F.lit(0.0))
    for k in sorted(sizes):
        if sum(n for f, n in sizes.items() if f < k) >= least:
            past = r.where(F.col("fold") < k).select(F.col(p).alias("_p"), F.col(y).cast("double").alias("_y"))
            model = IsotonicRegression(featuresCol="_p", labelCol="_y", predictionCol="calibrated").fit(past)
            out = out.unionByName(model.transform(r.where(F.col("fold") == k).withColumn("_p", F.col(p))).drop("_p"))
    return out


@query("isotonic_calibration")
def isotonic_calibration(spark, sf_dir) -> DataFrame:
    """Prequential calibration of the meta probabilities."""
    r = resolved(spark, sf_dir).select("id", "fold", "meta_prob", "correct")
    return calibrated(r).select("id", "fold", F.col("meta_prob").alias("p"), r6(F.col("calibrated")).alias("calibrated"))


def calibration_error(c: DataFrame, y: str = "correct", least: int = 100) -> DataFrame:
    """Calibration error of each fold of ``least`` rows or more, with its rows, and of all of them together (fold NULL), weighted by rows."""
    sums = c.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    bins = c.where("calibrated < 1").groupBy("fold", decile(F.col("calibrated")).alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.abs(F.avg("calibrated") - F.avg(y)).alias("gap"))
    each = sums.join(bins.groupBy("fold").agg(F.sum(F.col("k") * F.col("gap")).alias("s")), "fold", "left").select("fold", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("ece"), "n")
    return each.unionByName(each.agg(F.lit(None).cast("int").alias("fold"), (F.sum(F.col("ece") * F.col("n")) / F.sum("n")).alias("ece"), F.sum("n").alias("n")))


@query("ece_calibrated")
def ece_calibrated(spark, sf_dir) -> DataFrame:
    """Out-of-sample calibration error: each fold scored by the calibrator of the folds before it."""
    return calibration_error(calibrated(resolved(spark, sf_dir).select("fold", "meta_prob", "correct"))).withColumn("ece", r6(F.col("ece")))
