"""Cross-sectional portfolios, backtests, live books and sizing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import add_business_days, r6, sig_round
from ..operators import portfolio as pf
from ..operators import windows as w
from ..operators.asof import asof_forward, latest_per_group
from ..operators.labels import triple_barrier
from ..operators.training import stored
from ..registry import query
from ..sources.logical import bars, predictions, ticks, twin, verdicts
from .learning import _EVENTS, _W, events

_RB = ("rb", f"SELECT *, ln(close / lag(close) OVER {_W})) AS r FROM bars")
_MK = ("mk", "SELECT date, avg(r) AS m FROM rb GROUP BY date")


def _f(n: int) -> str:
    return f"OVER {_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_BV = ("bv", f"""SELECT symbol, date, lag(b) OVER {_W}) AS beta, lag(v) OVER {_W}) AS vol FROM (SELECT symbol, date, CASE WHEN count(r) {_f(60)} >= 30 THEN covar_samp(r, m) {_f(60)} / nullif(var_samp(CASE WHEN r IS NOT NULL THEN m END) {_f(60)}, 0) END AS b,
    CASE WHEN count(r) {_f(20)} >= 10 THEN stddev_samp(r) {_f(20)} END AS v FROM rb JOIN mk USING (date))""")


def with_risk(b: DataFrame) -> DataFrame:
    """Adds log return r and yesterday's rolling beta (60, at least 30) to the equal-weight market and volatility (20, at least 10)."""
    b = b.withColumn("r", w.log_return(F.col("close")))
    b = b.join(b.groupBy("date").agg(F.avg("r").alias("m")), "date")
    long, pair = w.trailing(60), F.when(F.col("r").isNotNull(), F.col("m"))
    beta = F.when(F.count("r").over(long) >= 30, F.covar_samp("r", "m").over(long) / F.nullif(F.var_samp(pair).over(long), F.lit(0.0)))
    b = b.withColumns({"_b": beta, "_v": w.rstd(F.col("r"), 20, 10)})
    return b.withColumns({"beta": w.lag(F.col("_b")), "vol": w.lag(F.col("_v"))}).drop("m", "_b", "_v")


@query("market_beta", twin("SELECT symbol, date, round(beta, 6) AS beta, round(vol, 6) AS vol FROM bv", _RB, _MK, _BV))
def market_beta(spark, sf_dir) -> DataFrame:
    return with_risk(bars(spark, sf_dir)).select("symbol", "date", r6(F.col("beta")).alias("beta"), r6(F.col("vol")).alias("vol"))


_PN = ("pn", """SELECT e.symbol, e.date, e.ret, coalesce(beta, 1) AS beta, CASE WHEN vol > 0 THEN vol ELSE md END AS vol, ascii(right(e.symbol, 1)) % 4 AS sector, 0.4::DOUBLE + (volume::BIGINT % 41) / 100::DOUBLE AS meta, ((volume::BIGINT * 7) % 41 - 20) / 100::DOUBLE * (0.4::DOUBLE + (volume::BIGINT % 41) / 100::DOUBLE) AS score,
    CASE month(e.date) % 3 WHEN 0 THEN 'trend' WHEN 1 THEN 'chop' ELSE 'risk_off' END AS regime FROM ev e JOIN bars USING (symbol, date) LEFT JOIN bv USING (symbol, date), (SELECT median(vol) AS md FROM bv WHERE vol > 0)""")
_PANEL = (*_EVENTS, _RB, _MK, _BV, _PN)


def panel(spark, sf_dir) -> DataFrame:
    """Event returns with point-in-time risk, sector, score and regime; missing risk takes beta 1 and the median volatility."""
    b = with_risk(bars(spark, sf_dir))  # one pass over the bars: all windows share an exchange and a sort
    median = b.where("vol > 0").agg(F.percentile("vol", 0.5).alias("md"))
    b = b.withColumn("width", w.rstd(F.col("r"), 20))
    e = triple_barrier(b.select("symbol", "date", "close", "volume", "beta", "vol", "width"), "width").crossJoin(F.broadcast(median))  # one row
    month, meta = F.month("date") % 3, 0.4 + (F.col("volume").cast("long") % 41) / 100
    return e.select("symbol", "date", "ret", F.coalesce("beta", F.lit(1.0)).alias("beta"), F.when(F.col("vol") > 0, F.col("vol")).otherwise(F.col("md")).alias("vol"), (F.ascii(F.right("symbol", F.lit(1))) % 4).alias("sector"),
        meta.alias("meta"), (((F.col("volume").cast("long") * 7) % 41 - 20) / 100 * meta).alias("score"), F.when(month == 0, "trend").when(month == 1, "chop").otherwise("risk_off").alias("regime"))


_DAY = "(PARTITION BY date)"
_BETA = "x - avg(x) OVER {d} - CASE WHEN stddev_pop(beta) OVER {d} < 1e-9 THEN 0 ELSE covar_pop(x, beta) OVER {d} / nullif(var_pop(beta) OVER {d}, 0) END * (beta - avg(beta) OVER {d})".format(d=_DAY)
for _mode, _x, _res in (("market", "ret", f"x - avg(x) OVER {_DAY}"), ("sector", "ret - avg(ret) OVER (PARTITION BY date, sector)", "x"), ("beta", "ret", _BETA), ("sector_beta", "ret - avg(ret) OVER (PARTITION BY date, sector)", _BETA)):

    @query(f"neutralise_{_mode}", twin(f"SELECT symbol, date, round(CASE WHEN count(*) OVER {_DAY} < 3 THEN ret ELSE {_res} END, 5) + 0 AS residual FROM (SELECT *, {_x} AS x FROM pn)", *_PANEL))
    def _neutralise(spark, sf_dir, mode=_mode) -> DataFrame:
        return pf.neutralise(panel(spark, sf_dir), "ret", mode).select("symbol", "date", F.round("residual", 5).alias("residual"))


_TOP = ("tp", f"SELECT * FROM (SELECT *, greatest(1, round_even(count(*) OVER {_DAY} * 0.2::DOUBLE, 0)) AS k, row_number() OVER (PARTITION BY date ORDER BY meta DESC, symbol) AS n FROM pn) WHERE n <= k")


def _leg_sql(name: str, src: str, by: str) -> tuple[str, str]:
    share = "CASE WHEN meta <= 0 OR meta >= 1 OR meta <= 0.5 THEN 0 ELSE least(0.5::DOUBLE, 0.25::DOUBLE * (2 * meta - 1)) END"
    tilt = f"CASE WHEN kf > 0 THEN kf ELSE coalesce(avg(kf) FILTER (WHERE kf > 0) OVER {by}, 1) END / vol"
    return name, f"SELECT *, CASE WHEN sum(u) OVER {by} > 1e-12 THEN u / nullif(sum(u) OVER {by}, 0) ELSE 1 / (count(*) OVER {by})::DOUBLE END AS weight FROM (SELECT *, {tilt} AS u FROM (SELECT *, {share} AS kf FROM {src}))"


_LEG = _leg_sql("lg", "tp", _DAY)


@query("leg_weights", twin("SELECT symbol, date, meta, round(weight, 6) AS weight FROM lg", *_PANEL, _TOP, _LEG))
def leg_weights(spark, sf_dir) -> DataFrame:
    return pf.leg_weights(pf.top_fraction(panel(spark, sf_dir), "meta", 0.2)).select("symbol", "date", "meta", r6(F.col("weight")).alias("weight"))


_BD10 = "(d + CASE WHEN isodow(d) <= 5 THEN 14 WHEN isodow(d) = 6 THEN 13 ELSE 12 END)::DATE"
_GRID = (("vd", "SELECT date AS d FROM pn GROUP BY date HAVING count(*) >= 8"), ("gr", f"SELECT min(d) AS d FROM vd UNION ALL SELECT (SELECT min(v.d) FROM vd v WHERE v.d >= {_BD10.replace('d +', 'gr.d +').replace('isodow(d)', 'isodow(gr.d)')}) FROM gr WHERE gr.d IS NOT NULL"))


def grid(p: DataFrame) -> DataFrame:
    """Rebalance dates ten weekdays apart; dates with fewer than eight names do not use up a slot."""
    wide = p.groupBy("date").agg(F.count(F.lit(1)).alias("n")).where("n >= 8")
    return pf.spaced_dates(wide, lambda d: add_business_days(d, 10))


@query("rebalance_grid", twin("SELECT d AS date FROM gr WHERE d IS NOT NULL", *_PANEL, *_GRID, recursive=True))
def rebalance_grid(spark, sf_dir) -> DataFrame:
    return grid(panel(spark, sf_dir))


_EXPANDING = "OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LEGS = ("sl", f"SELECT * FROM (SELECT *, CASE WHEN place <= k THEN 'long' WHEN place > n - k THEN 'short' END AS leg FROM (SELECT *, ret - avg(ret) OVER {_DAY} AS residual, count(*) OVER {_DAY} AS n, greatest(1, round_even(count(*) OVER {_DAY} * 0.2::DOUBLE, 0)) AS k, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS place FROM pn JOIN (SELECT d AS date FROM gr WHERE d IS NOT NULL) USING (date))) WHERE leg IS NOT NULL")
_SIM = ("sm", """SELECT date, (0.5::DOUBLE * (up - 0.0005::DOUBLE) + 0.5::DOUBLE * (down - 0.0005::DOUBLE)) * CASE rg WHEN 'chop' THEN 0.6::DOUBLE WHEN 'risk_off' THEN 0.25::DOUBLE ELSE 1 END AS ret, breadth, n_leg FROM (SELECT date, sum(weight * residual) FILTER (WHERE leg = 'long') AS up, -sum(weight * residual) FILTER (WHERE leg = 'short') AS down,
    min(regime) AS rg, max(n)::BIGINT AS breadth, max(k)::BIGINT AS n_leg FROM sw GROUP BY date)""")
_BOOKED = (*_PANEL, *_GRID, _LEGS, _leg_sql("sw", "sl", "(PARTITION BY date, leg)"), _SIM)


def simulated(spark, sf_dir) -> DataFrame:
    p = stored(panel(spark, sf_dir), "panel")  # the grid and the book read it
    return pf.simulate(p, grid(p), mode="market")


@query("portfolio_sim", twin("SELECT date, round(ret, 6) AS ret, breadth, n_leg FROM sm", *_BOOKED, recursive=True))
def portfolio_sim(spark, sf_dir) -> DataFrame:
    """Market-neutral long and short quintiles by edge times meta probability, a return per rebalance date."""
    return simulated(spark, sf_dir).withColumn("ret", r6(F.col("ret")))


_TARGET, _PERIODS = 0.3 / 26**0.5, 26.0
_LEV = f"CASE WHEN count(ret) {_EXPANDING} < 10 OR stddev_samp(ret) {_EXPANDING} <= 1e-12::DOUBLE THEN 1 ELSE least(3, {_TARGET!r}::DOUBLE / nullif(stddev_samp(ret) {_EXPANDING}, 0)) END"
_REPORT = f"""SELECT count(*)::BIGINT AS periods, round(avg(breadth), 4) AS avg_breadth, round(avg(x) / stddev_samp(x) * sqrt({_PERIODS!r}::DOUBLE), 4) AS sharpe, round(arg_max(e, date) - 1, 4) AS total_return, round(pow(1 + avg(x), {_PERIODS!r}::DOUBLE) - 1, 4) AS ann_return, round(stddev_samp(x), 6) AS vol_per_period,
  round(min(e / m - 1), 4) AS max_dd, round(avg((x > 0)::INT), 4) AS win_rate, CASE WHEN sum(least(x, 0)) = 0 THEN 'Infinity'::DOUBLE ELSE round(sum(greatest(x, 0)) / -sum(least(x, 0)), 4) END AS profit_factor FROM
  (SELECT *, max(e) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT *, product(1 + x) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT date, breadth, ret * {_LEV} AS x FROM sm)))"""


@query("portfolio_report", twin(_REPORT, *_BOOKED, recursive=True))
def portfolio_report(spark, sf_dir) -> DataFrame:
    """The simulated book under a volatility target of 30 percent a year: one row."""
    r = pf.vol_target(simulated(spark, sf_dir), "ret", _TARGET).withColumn("k", F.lit(0))
    m = pf.performance(r, "scaled", ["k"], "date", _PERIODS).join(r.groupBy("k").agg(F.avg("breadth").alias("breadth")), "k")
    fixed = lambda c, n=4: F.round(c, n)
    return m.select(
        F.col("n").alias("periods"), fixed("breadth").alias("avg_breadth"), fixed("sharpe").alias("sharpe"), fixed("total_return").alias("total_return"), fixed("annual_return").alias("ann_return"), fixed("deviation", 6).alias("vol_per_period"),
        fixed("max_drawdown").alias("max_dd"), fixed("win_rate").alias("win_rate"), F.when(F.col("profit_factor") == float("inf"), F.col("profit_factor")).otherwise(fixed("profit_factor")).alias("profit_factor"),
    )


@query("benchmark", twin("SELECT date, round(avg(ret), 6) AS ret, count(*)::BIGINT AS n FROM pn JOIN gr ON gr.d = pn.date GROUP BY date", *_PANEL, *_GRID, recursive=True))
def benchmark(spark, sf_dir) -> DataFrame:
    """Own everything on the rebalance dates."""
    p = panel(spark, sf_dir)
    return p.join(grid(p), "date").groupBy("date").agg(r6(F.avg("ret")).alias("ret"), F.count(F.lit(1)).alias("n"))


_EXP = _EXPANDING


_LEVER = f"CASE WHEN count(m) {_EXP} < 10 OR stddev_samp(m) {_EXP} <= 1e-12::DOUBLE THEN 1 ELSE least(3, 0.05::DOUBLE / nullif(stddev_samp(m) {_EXP}, 0)) END"


@query("vol_target", twin(f"SELECT date, round({_LEVER}, 6) AS leverage, round(m * {_LEVER}, 6) AS ret FROM mk WHERE m IS NOT NULL", _RB, _MK))
def vol_target(spark, sf_dir) -> DataFrame:
    """Market returns scaled by the leverage that the deviation of earlier dates asks for."""
    m = bars(spark, sf_dir).select("symbol", "date", w.log_return(F.col("close")).alias("r")).groupBy("date").agg(F.avg("r").alias("m")).where("m is not null")
    return pf.vol_target(m, "m", 0.05).select("date", r6(F.col("leverage")).alias("leverage"), r6(F.col("scaled")).alias("ret"))


def _perf_sql(src: str, by: str, periods: float) -> str:
    e = f"(PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT {by}, count(*)::BIGINT AS n, round(CASE WHEN count(x) < 2 OR stddev_samp(x) = 0 THEN 0 ELSE avg(x) / nullif(stddev_samp(x), 0) * sqrt({periods!r}::DOUBLE) END, 5) AS sharpe, round(min(dd), 5) AS max_drawdown, CASE WHEN sum(least(x, 0)) = 0 THEN 'Infinity'::DOUBLE ELSE round(sum(greatest(x, 0)) / nullif(-sum(least(x, 0)), 0), 5) END AS profit_factor,
    round(avg((x > 0)::INT), 6) AS win_rate FROM (SELECT *, e / max(e) OVER {e} - 1 AS dd FROM (SELECT *, product(1 + x) OVER {e} AS e FROM {src})) GROUP BY {by}"""


@query("drawdown_sharpe", twin(_perf_sql("(SELECT symbol, date, exp(r) - 1 AS x FROM rb WHERE r IS NOT NULL)", "symbol", 52.0), _RB))
def drawdown_sharpe(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir).select("symbol", "date", (F.exp(w.log_return(F.col("close"))) - 1).alias("x")).where("x is not null")
    p = pf.performance(b, "x", ["symbol"], "date", 52.0)
    return p.select("symbol", "n", F.round("sharpe", 5).alias("sharpe"), F.round("max_drawdown", 5).alias("max_drawdown"), F.when(F.col("profit_factor") == float("inf"), F.col("profit_factor")).otherwise(F.round("profit_factor", 5)).alias("profit_factor"), r6(F.col("win_rate")).alias("win_rate"))


_SIG = f"(CASE WHEN count(close) {_f(20)} >= 20 THEN (avg(close) {_f(5)} > avg(close) {_f(20)})::INT END)"


@query("sma_cross_backtest", twin(f"""SELECT symbol, count(*) FILTER (WHERE chg <> 0)::BIGINT AS n_trades, round(sum(CASE WHEN held = 1 THEN r ELSE 0 END), 5) AS log_return, round(avg(held), 6) AS exposure FROM (
    SELECT *, s - lag(s) OVER {_W}) AS chg, coalesce(lag(s) OVER {_W}), 0) AS held FROM (SELECT symbol, date, ln(close / lag(close) OVER {_W})) AS r, {_SIG} AS s FROM bars)) WHERE s IS NOT NULL GROUP BY symbol"""))
def sma_cross_backtest(spark, sf_dir) -> DataFrame:
    """All in while the short average is above the long one; a position earns from the bar after its signal."""
    c = F.col("close")
    b = bars(spark, sf_dir).select("symbol", "date", w.log_return(c).alias("r"), F.when(F.count(c).over(w.trailing(20)) >= 20, (F.avg(c).over(w.trailing(5)) > F.avg(c).over(w.trailing(20))).cast("int")).alias("s"))
    b = b.withColumn("chg", F.col("s") - w.lag(F.col("s"))).withColumn("held", F.coalesce(w.lag(F.col("s")), F.lit(0))).where("s is not null")
    return b.groupBy("symbol").agg(F.count(F.when(F.col("chg") != 0, 1)).alias("n_trades"), F.round(F.sum(F.when(F.col("held") == 1, F.col("r")).otherwise(0.0)), 5).alias("log_return"), r6(F.avg("held")).alias("exposure"))


_SEL = (("cd", "SELECT e.symbol, e.date, e.t1, e.ret, row_number() OVER (PARTITION BY e.symbol ORDER BY e.date) AS rn FROM ev e JOIN bars b ON e.symbol = b.symbol AND e.date = b.date WHERE 0.4::DOUBLE + (b.volume::BIGINT % 41) / 100::DOUBLE >= 0.6::DOUBLE"),
    ("sl", "SELECT symbol, date, ret, rn, t1 AS free, true AS taken FROM cd WHERE rn = 1 UNION ALL SELECT c.symbol, c.date, c.ret, c.rn, CASE WHEN c.date >= s.free THEN c.t1 ELSE s.free END, c.date >= s.free FROM sl s JOIN cd c ON c.symbol = s.symbol AND c.rn = s.rn + 1"))


@query("per_symbol_backtest", twin("SELECT symbol, count(*)::BIGINT AS n, round(avg(ret), 6) AS mean_ret, round(avg((ret > 0)::INT), 6) AS win_rate FROM sl WHERE taken GROUP BY symbol HAVING count(*) >= 5", *_EVENTS, *_SEL, recursive=True))
def per_symbol_backtest(spark, sf_dir) -> DataFrame:
    """Trades that do not overlap: an event is taken if no earlier trade of its symbol is open; a fold over each symbol's events that carries sums only."""
    e = events(spark, sf_dir).join(bars(spark, sf_dir).select("symbol", "date", "volume"), ["symbol", "date"]).where(0.4 + (F.col("volume").cast("long") % 41) / 100 >= 0.6)
    start = F.struct(F.lit(None).cast("date").alias("free"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("won"))
    taken = lambda a, x: F.struct(x["t1"].alias("free"), (a["n"] + 1).alias("n"), (a["total"] + x["ret"]).alias("total"), (a["won"] + (x["ret"] > 0).cast("long")).alias("won"))
    fold = F.aggregate(F.sort_array(F.collect_list(F.struct("date", "t1", "ret"))), start, lambda a, x: F.when(a["free"].isNull() | (x["date"] >= a["free"]), taken(a, x)).otherwise(a))
    r = e.groupBy("symbol").agg(fold.alias("f")).select("symbol", "f.*").where("n >= 5")
    return r.select("symbol", "n", r6(F.col("total") / F.col("n")).alias("mean_ret"), r6(F.col("won") / F.col("n")).alias("win_rate"))


_LATEST = ("la", "SELECT * FROM predictions p WHERE generated_at = (SELECT max(generated_at) FROM predictions q WHERE q.symbol = p.symbol)")
_BOOK = ("bk", """SELECT symbol, prob_up, meta_prob, regime, confidence, g * 0.5::DOUBLE / count(*) OVER () AS weight FROM (SELECT *, CASE regime WHEN 'chop' THEN 0.6::DOUBLE WHEN 'risk_off' THEN 0.25::DOUBLE ELSE 1 END AS g, row_number() OVER (ORDER BY prob_up DESC, symbol) AS n, (SELECT count(*) FROM la) AS u FROM la WHERE prob_up > 0.5)
    WHERE n <= greatest(1, round_even(u * 0.3::DOUBLE, 0))""")


def book(spark, sf_dir, frac: float = 0.3, leverage: float = 0.5) -> DataFrame:
    """Latest bullish names, the top fraction of the whole universe, equal weight, scaled by regime and leverage; a row per symbol."""
    latest = latest_per_group(predictions(spark, sf_dir), ["symbol"], "generated_at")
    everything = Window.partitionBy(F.lit(0))  # one row per symbol of the universe
    ranked = latest.withColumn("u", F.count(F.lit(1)).over(everything)).where("prob_up > 0.5").withColumn("n", F.row_number().over(everything.orderBy(F.desc("prob_up"), "symbol")))
    held = ranked.where(F.col("n") <= F.greatest(F.lit(1), F.bround(F.col("u") * F.lit(frac))))
    return held.select("symbol", "prob_up", "meta_prob", "regime", "confidence", (pf.regime_scale(F.col("regime")) * leverage / F.count(F.lit(1)).over(everything)).alias("weight"))


@query("live_book", twin("SELECT symbol, prob_up, regime, round(weight, 6) AS weight FROM bk", _LATEST, _BOOK))
def live_book(spark, sf_dir) -> DataFrame:
    return book(spark, sf_dir).select("symbol", "prob_up", "regime", r6(F.col("weight")).alias("weight"))


def valved(spark, sf_dir) -> DataFrame:
    """A veto drops a name, a downgrade scales it, nothing is ever raised, and the rest is not renormalised."""
    at = F.struct("generated_at", "id")
    v = verdicts(spark, sf_dir).where("insight_type = 'verdict'").groupBy("symbol").agg(F.max_by("label", at).alias("label"), F.max_by("llm_confidence", at).alias("llm_confidence"))
    b = book(spark, sf_dir).join(v, "symbol", "left").where("label is null or label <> 'veto'")
    low = F.least("confidence", "llm_confidence")
    weight = F.when((F.col("label") == "downgrade") & (F.col("confidence") > 0), F.col("weight") * low / F.nullif("confidence", F.lit(0))).otherwise(F.col("weight"))
    return b.select("symbol", weight.alias("weight"), F.when(F.col("label").isNull(), F.col("confidence")).otherwise(low).alias("final_confidence"))


@query("verdict_valve", twin("""SELECT symbol, round(CASE WHEN label = 'downgrade' AND confidence > 0 THEN weight * least(confidence, llm_confidence) / confidence ELSE weight END, 6) AS weight, CASE WHEN label IS NULL THEN confidence ELSE least(confidence, llm_confidence) END AS final_confidence
    FROM bk LEFT JOIN (SELECT symbol, arg_max(label, (generated_at, id)) AS label, arg_max(llm_confidence, (generated_at, id)) AS llm_confidence FROM verdicts WHERE insight_type = 'verdict' GROUP BY symbol) USING (symbol) WHERE label IS NULL OR label <> 'veto'""", _LATEST, _BOOK))
def verdict_valve(spark, sf_dir) -> DataFrame:
    return valved(spark, sf_dir).withColumn("weight", r6(F.col("weight")))


_KELLY = "CASE WHEN prob_up <= 0 OR prob_up >= 1 OR 2 * prob_up - 1 <= 0 THEN 0 ELSE least(0.5::DOUBLE, 0.25::DOUBLE * (2 * prob_up - 1)) END"


@query("kelly", twin(f"SELECT id, prob_up, round({_KELLY}, 6) AS kelly, CASE regime WHEN 'chop' THEN 0.6::DOUBLE WHEN 'risk_off' THEN 0.25::DOUBLE ELSE 1::DOUBLE END AS scale FROM predictions"))
def kelly(spark, sf_dir) -> DataFrame:
    return predictions(spark, sf_dir).select("id", "prob_up", r6(pf.kelly_fraction(F.col("prob_up"))).alias("kelly"), pf.regime_scale(F.col("regime")).alias("scale"))


@query("order_plan", twin(f"SELECT id, symbol, round(least(10000, 50000 * k), 2) AS notional FROM (SELECT *, {_KELLY} AS k FROM predictions) WHERE act = 1 AND k > 0 AND least(10000, 50000 * k) >= 1"))
def order_plan(spark, sf_dir) -> DataFrame:
    p = predictions(spark, sf_dir).where("act = 1").withColumn("k", pf.kelly_fraction(F.col("prob_up"))).where("k > 0")
    return p.select("id", "symbol", F.round(F.least(F.lit(10000.0), 50000 * F.col("k")), 2).alias("notional")).where("notional >= 1")


@query("confidence_tilt", twin("""SELECT p.id, round(least(100, greatest(0, confidence * least(1.2::DOUBLE, greatest(0.5::DOUBLE, CASE WHEN v.sentiment IS NULL OR v.sentiment = 'neutral' THEN 1 WHEN (v.sentiment = 'bullish') = (prob_up >= 0.5) THEN 1.2::DOUBLE ELSE 0.6::DOUBLE END)))), 4) AS confidence
    FROM predictions p LEFT JOIN verdicts v ON v.id = p.id"""))
def confidence_tilt(spark, sf_dir) -> DataFrame:
    """Agreeing sentiment raises confidence by a fifth, opposing sentiment cuts it by two fifths; within 0 to 100."""
    v = verdicts(spark, sf_dir).select("id", "sentiment")
    agrees = (F.col("sentiment") == "bullish") == (F.col("prob_up") >= 0.5)
    tilt = F.when(F.col("sentiment").isNull() | (F.col("sentiment") == "neutral"), 1.0).when(agrees, 1.2).otherwise(0.6)
    return predictions(spark, sf_dir).join(v, "id", "left").select("id", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("confidence") * tilt)), 4).alias("confidence"))


@query("band_prices", twin("SELECT id, round(last_close * (1 + (2 * prob_up - 1) * 0.02::DOUBLE * 0.5::DOUBLE), 6) AS pred_price, round(last_close * (1 + (2 * prob_up - 1) * 0.01::DOUBLE - 1.09::DOUBLE * 0.02::DOUBLE), 6) AS lo, round(last_close * (1 + (2 * prob_up - 1) * 0.01::DOUBLE + 1.09::DOUBLE * 0.02::DOUBLE), 6) AS hi FROM predictions"))
def band_prices(spark, sf_dir) -> DataFrame:
    """Direction-implied drift and the conformal band around it, as prices."""
    scale, q = 0.02, 1.09
    drift, half = (2 * F.col("prob_up") - 1) * scale * 0.5, q * max(scale, 1e-6)
    price = lambda r: r6(F.col("last_close") * (1 + r))
    return predictions(spark, sf_dir).select("id", price(drift).alias("pred_price"), price(drift - half).alias("lo"), price(drift + half).alias("hi"))


@query("resolve_outcomes", twin("""SELECT id, round(ret, 6) AS actual_return, (sign(ret) = CASE WHEN prob_up >= 0.5 THEN 1 ELSE -1 END)::INT AS correct, round(CASE WHEN act = 1 THEN CASE WHEN prob_up >= 0.5 THEN ret ELSE -ret END - 0.0005::DOUBLE ELSE 0 END, 6) AS pnl, (px BETWEEN band_lo AND band_hi)::INT AS in_band FROM (
    SELECT p.*, m.px, m.px / nullif(last_close, 0) - 1 AS ret FROM predictions p ASOF JOIN (SELECT symbol, ts::DATE AS date, arg_max(price, (ts, id)) AS px FROM ticks GROUP BY ALL) m ON p.symbol = m.symbol AND p.target_date <= m.date)"""))
def resolve_outcomes(spark, sf_dir) -> DataFrame:
    """Due predictions against the first close on or after their target date."""
    m = ticks(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max_by("price", F.struct("ts", "id")).alias("px"))
    p = asof_forward(predictions(spark, sf_dir).withColumn("date", F.col("target_date")), m, ["symbol"], "date", ["px"]).where("px is not null")
    ret, up = F.try_divide("px", F.nullif("last_close", F.lit(0.0))) - 1, F.col("prob_up") >= 0.5
    p = p.withColumn("ret", ret)
    return p.select("id", r6(F.col("ret")).alias("actual_return"), (F.signum("ret") == F.when(up, 1.0).otherwise(-1.0)).cast("int").alias("correct"), r6(F.when(F.col("act") == 1, F.when(up, F.col("ret")).otherwise(-F.col("ret")) - 0.0005).otherwise(0.0)).alias("pnl"), F.col("px").between(F.col("band_lo"), F.col("band_hi")).cast("int").alias("in_band"))


@query("significant_figures", twin("SELECT id, CASE WHEN price = 0 THEN 0 ELSE round(price * pow(10::DOUBLE, 2 - floor(log10(abs(price))))) / pow(10::DOUBLE, 2 - floor(log10(abs(price)))) END AS price_3sf FROM ticks"))
def significant_figures(spark, sf_dir) -> DataFrame:
    return ticks(spark, sf_dir).select("id", sig_round(F.col("price"), 3).alias("price_3sf"))


@query("daily_cycle_orders", twin("""SELECT symbol, round(least(10000, 50000 * weight), 2) AS notional FROM (SELECT bk.symbol, CASE WHEN label = 'downgrade' AND confidence > 0 THEN weight * least(confidence, llm_confidence) / confidence ELSE weight END AS weight FROM bk LEFT JOIN
    (SELECT symbol, arg_max(label, (generated_at, id)) AS label, arg_max(llm_confidence, (generated_at, id)) AS llm_confidence FROM verdicts WHERE insight_type = 'verdict' GROUP BY symbol) v ON v.symbol = bk.symbol WHERE label IS NULL OR label <> 'veto') WHERE 50000 * weight >= 1""", _LATEST, _BOOK))
def daily_cycle_orders(spark, sf_dir) -> DataFrame:
    """The day's chain: latest predictions, book, verdicts, orders."""
    orders = valved(spark, sf_dir).select("symbol", (50000 * F.col("weight")).alias("n")).where("n >= 1")
    return orders.select("symbol", F.round(F.least(F.lit(10000.0), F.col("n")), 2).alias("notional"))
