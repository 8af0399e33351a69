"""Alternative-data blocks: funding, open interest, on-chain, sentiment, filings and macro series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import clip, r6, safe_div
from ..operators import windows as w
from ..operators.asof import asof_backward, daily_spine
from ..registry import query
from ..sources.logical import bars, news, raw, ticks, twin

_W = "(PARTITION BY symbol ORDER BY date"
_AL = ("al", "SELECT symbol, ts::DATE AS date, sum(price) AS total, arg_max(price, (ts, id)) AS last, avg(price) AS mean, count(*)::BIGINT AS n FROM ticks GROUP BY ALL")


def alt(spark, sf_dir) -> DataFrame:
    t = ticks(spark, sf_dir)
    return t.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.sum("price").alias("total"), F.max_by("price", F.struct("ts", "id")).alias("last"), F.avg("price").alias("mean"), F.count(F.lit(1)).alias("n"))


def _fr(n: int) -> str:
    return f"OVER {_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _m(c: str, n: int, least: int | None = None, agg: str = "avg") -> str:
    return f"CASE WHEN count({c}) {_fr(n)} >= {least or n} THEN {agg}({c}) {_fr(n)} END"


def _z(c: str, n: int, least: int) -> str:
    return f"(({c}) - ({_m(c, n, least)})) / nullif({_m(c, n, least, 'stddev_samp')}, 0)"


def _clip(e: str, low, high) -> str:
    return f"CASE WHEN ({e}) IS NOT NULL THEN least(greatest(({e}), {low}::DOUBLE), {high}::DOUBLE) END"


@query("funding_daily", twin("SELECT symbol, date, round(total, 4) AS funding, last AS funding_last FROM al", _AL))
def funding_daily(spark, sf_dir) -> DataFrame:
    return alt(spark, sf_dir).select("symbol", "date", F.round("total", 4).alias("funding"), F.col("last").alias("funding_last"))


@query("oi_daily", twin("SELECT symbol, ts::DATE AS date, arg_max(price, (ts, id)) FILTER (WHERE event_type <> 'error') AS oi, round(avg(price) FILTER (WHERE event_type <> 'error'), 6) AS oi_mean FROM ticks GROUP BY ALL"))
def oi_daily(spark, sf_dir) -> DataFrame:
    """Last and mean of the day's usable snapshots."""
    ok = F.col("event_type") != "error"
    return ticks(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max_by("price", F.when(ok, F.struct("ts", "id"))).alias("oi"), r6(F.avg(F.when(ok, F.col("price")))).alias("oi_mean"))


@query("funding_feats", twin(f"SELECT symbol, date, last AS level, round({_z('last', 20, 10)}, 6) AS z20, {_m('flip', 8, None, 'sum')}::BIGINT AS flips8, round({_m('last', 8, None, 'sum')}, 4) AS cum8 FROM (SELECT *, CASE WHEN lag(last) OVER {_W}) IS NOT NULL THEN (sign(last - 20) <> sign(lag(last) OVER {_W}) - 20))::INT END AS flip FROM al)", _AL))
def funding_feats(spark, sf_dir) -> DataFrame:
    last = F.col("last")
    a = alt(spark, sf_dir).withColumn("before", w.lag(last)).withColumn("flip", F.when(F.col("before").isNotNull(), (F.signum(last - 20) != F.signum(F.col("before") - 20)).cast("int")))
    return a.select("symbol", "date", last.alias("level"), r6(w.zscore(last, 20, 10)).alias("z20"), w.rsum(F.col("flip"), 8).alias("flips8"), F.round(w.rsum(last, 8), 4).alias("cum8"))


@query("oi_feats", twin(f"SELECT symbol, date, round({_clip(f'last / nullif(lag(last) OVER {_W}), 0) - 1', -1, 1)}, 6) AS change, round({_clip('last / nullif(total, 0)', 0, 50)}, 6) AS to_volume, round({_z('last', 20, 10)}, 6) AS z20 FROM al", _AL))
def oi_feats(spark, sf_dir) -> DataFrame:
    last = F.col("last")
    return alt(spark, sf_dir).select("symbol", "date", r6(clip(w.change(last), -1.0, 1.0)).alias("change"), r6(clip(safe_div(last, F.col("total")), 0.0, 50.0)).alias("to_volume"), r6(w.zscore(last, 20, 10)).alias("z20"))


@query("dvol_feats", twin(f"SELECT symbol, date, round(mean / 100, 10) AS level, round(ln(mean / nullif(lag(mean) OVER {_W}), 0)), 6) AS log_change FROM al", _AL))
def dvol_feats(spark, sf_dir) -> DataFrame:
    return alt(spark, sf_dir).select("symbol", "date", F.round(F.col("mean") / 100, 10).alias("level"), r6(w.log_return(F.col("mean"))).alias("log_change"))


@query("onchain_feats", twin(f"SELECT symbol, date, round({_z('nvt', 30, 10)}, 6) AS nvt_z30, round(ln(m7 / nullif(lag(m7, 7) OVER {_W}), 0)), 6) AS growth7 FROM (SELECT *, ln(total / n) AS nvt, {_m('n', 7, 3)} AS m7 FROM al WHERE NOT (n = 0 AND total = 0))", _AL))
def onchain_feats(spark, sf_dir) -> DataFrame:
    a = alt(spark, sf_dir).where(~((F.col("n") == 0) & (F.col("total") == 0)))
    a = a.withColumn("nvt", F.log(F.col("total") / F.col("n"))).withColumn("m7", w.rmean(F.col("n"), 7, 3))
    return a.select("symbol", "date", r6(w.zscore(F.col("nvt"), 30, 10)).alias("nvt_z30"), r6(w.log_return(F.col("m7"), 7)).alias("growth7"))


@query("sentiment_feats", twin(f"SELECT symbol, date, round({_clip('mean / 10', -1, 1)}, 6) AS tone, round({_clip(_z('mean', 30, 10), -4, 4)}, 6) AS tone_z, round(({_m('mean', 7, 3)}) - ({_m('mean', 30, 10)}), 6) AS momentum, round({_z('lv', 30, 10)}, 6) AS vol_z FROM (SELECT *, ln(1 + n) AS lv FROM al)", _AL))
def sentiment_feats(spark, sf_dir) -> DataFrame:
    mean = F.col("mean")
    a = alt(spark, sf_dir).withColumn("lv", F.log1p("n"))
    return a.select("symbol", "date", r6(clip(mean / 10, -1.0, 1.0)).alias("tone"), r6(clip(w.zscore(mean, 30, 10), -4.0, 4.0)).alias("tone_z"), r6(w.rmean(mean, 7, 3) - w.rmean(mean, 30, 10)).alias("momentum"), r6(w.zscore(F.col("lv"), 30, 10)).alias("vol_z"))


@query("weighted_news", twin("SELECT symbol, round(CASE WHEN sum(rel) > 0 THEN sum(rel * score) / sum(rel) ELSE avg(score) END, 6) AS sentiment, round(avg(rel), 6) AS relevance, count(*)::BIGINT AS n FROM (SELECT symbol, score, (n_chars % 5) / 4::DOUBLE AS rel FROM news WHERE score IS NOT NULL) GROUP BY symbol"))
def weighted_news(spark, sf_dir) -> DataFrame:
    """Relevance-weighted mean, plain mean where nothing is relevant."""
    n = news(spark, sf_dir).where("score is not null").withColumn("rel", (F.col("n_chars") % 5) / 4)
    return n.groupBy("symbol").agg(r6(F.when(F.sum("rel") > 0, F.sum(F.col("rel") * F.col("score")) / F.nullif(F.sum("rel"), F.lit(0.0))).otherwise(F.avg("score"))).alias("sentiment"), r6(F.avg("rel")).alias("relevance"), F.count(F.lit(1)).alias("n"))


@query("sentiment_agg", twin("""SELECT symbol, round(s, 6) AS sentiment, CASE WHEN s > 0.15::DOUBLE THEN 'bullish' WHEN s < -0.15::DOUBLE THEN 'bearish' ELSE 'neutral' END AS label, n FROM (SELECT y.symbol, coalesce(sum(wt * score) / nullif(sum(wt), 0), 0) AS s, count(wt)::BIGINT AS n FROM (SELECT DISTINCT symbol FROM news WHERE symbol <> 'src0') y LEFT JOIN
    (SELECT symbol, score, pow(0.5::DOUBLE, (DATE '2024-02-01' - published) / 3::DOUBLE) * CASE WHEN symbol = 'src0' THEN 1 ELSE 2 END AS wt FROM news WHERE score IS NOT NULL AND published >= DATE '2024-01-18') x ON x.symbol = y.symbol OR x.symbol = 'src0' GROUP BY y.symbol)"""))
def sentiment_agg(spark, sf_dir) -> DataFrame:
    """Recency-weighted sentiment of a symbol's own (twice) and the general news; the OR is a union of two aggregates."""
    n = news(spark, sf_dir)
    recent = n.where("score is not null and published >= date'2024-01-18'").withColumn("wt", F.pow(F.lit(0.5), F.datediff(F.lit("2024-02-01").cast("date"), "published") / 3))
    sums = recent.groupBy("symbol").agg(F.sum(F.col("wt") * F.col("score")).alias("ws"), F.sum("wt").alias("w"), F.count(F.lit(1)).alias("n"))
    return blended_sentiment(n.select("symbol").distinct(), sums, "src0")


def blended_sentiment(symbols: DataFrame, sums: DataFrame, general: str) -> DataFrame:
    """Own sums (``ws``, ``w``, ``n`` by symbol) twice and those of the symbol ``general`` once; neutral where there is neither."""
    z = lambda c: F.coalesce(c, F.lit(0))
    common = sums.where(F.col("symbol") == general).agg(F.sum("ws").alias("gs"), F.sum("w").alias("gw"), F.sum("n").alias("gn"))  # one row, even if there is no general news
    own = symbols.where(F.col("symbol") != general).join(sums, "symbol", "left").crossJoin(F.broadcast(common))
    s = own.withColumn("s", z(safe_div(2 * z("ws") + z("gs"), 2 * z("w") + z("gw"))))
    label = F.when(F.col("s") > 0.15, "bullish").when(F.col("s") < -0.15, "bearish").otherwise("neutral")
    return s.select("symbol", r6(F.col("s")).alias("sentiment"), label.alias("label"), (z("n") + z("gn")).cast("long").alias("n"))


_Q = ("q", "SELECT 'C' || (o_custkey % 20)::VARCHAR AS symbol, year(o_orderdate) AS fy, quarter(o_orderdate) AS fp, sum(o_totalprice) AS quarter_revenue, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS income FROM orders GROUP BY ALL")
_FI = ("fi", """SELECT symbol, fy::INT AS fy, fp::INT AS fp, (last_day(make_date(fy, fp * 3, 1)) + 40)::DATE AS date, round(sum(quarter_revenue) OVER (PARTITION BY symbol, fy ORDER BY fp), 2) AS ytd, round(sum(income) OVER (PARTITION BY symbol, fy ORDER BY fp), 2) AS ytd_income FROM q""")


def filings(spark, sf_dir) -> DataFrame:
    """Cumulative year-to-date filings: symbol, fy, fp, date (filed), ytd, ytd_income."""
    o = raw(spark, sf_dir, "orders").select(F.concat(F.lit("C"), (F.col("o_custkey") % 20).cast("string")).alias("symbol"), F.year("o_orderdate").alias("fy"), F.quarter("o_orderdate").alias("fp"), "o_totalprice", "o_orderstatus")
    q = o.groupBy("symbol", "fy", "fp").agg(F.sum("o_totalprice").alias("rev"), F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("inc"))
    year = Window.partitionBy("symbol", "fy").orderBy("fp").rowsBetween(Window.unboundedPreceding, 0)
    return q.select("symbol", "fy", "fp", F.date_add(F.last_day(F.make_date("fy", F.col("fp") * 3, F.lit(1))), 40).alias("date"), F.round(F.sum("rev").over(year), 2).alias("ytd"), F.round(F.sum("inc").over(year), 2).alias("ytd_income"))


_QT = ("qt", "SELECT *, ytd - coalesce(lag(ytd) OVER (PARTITION BY symbol, fy ORDER BY fp), 0) AS rev, ytd_income - coalesce(lag(ytd_income) OVER (PARTITION BY symbol, fy ORDER BY fp), 0) AS inc FROM fi")


def quarters(spark, sf_dir) -> DataFrame:
    year = Window.partitionBy("symbol", "fy").orderBy("fp")
    single = lambda c: F.col(c) - F.coalesce(F.lag(c).over(year), F.lit(0.0))
    return filings(spark, sf_dir).select("*", single("ytd").alias("rev"), single("ytd_income").alias("inc"))


@query("quarterly_recon", twin("SELECT symbol, fy, fp, round(rev, 2) AS revenue, round(inc, 2) AS income FROM qt", _Q, _FI, _QT))
def quarterly_recon(spark, sf_dir) -> DataFrame:
    return quarters(spark, sf_dir).select("symbol", "fy", "fp", F.round("rev", 2).alias("revenue"), F.round("inc", 2).alias("income"))


_YOY = ("yy", "SELECT *, rev - lag(rev) OVER (PARTITION BY symbol, fp ORDER BY fy) AS surprise, rev / nullif(lag(rev) OVER (PARTITION BY symbol, fp ORDER BY fy), 0) - 1 AS growth FROM qt")
_SD8 = "(PARTITION BY symbol ORDER BY fy, fp ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
_SUE = ("su", f"SELECT *, surprise / nullif(CASE WHEN count(surprise) OVER {_SD8} >= 4 THEN stddev_samp(surprise) OVER {_SD8} END, 0) AS z FROM yy")


def surprises(spark, sf_dir) -> DataFrame:
    same, run = Window.partitionBy("symbol", "fp").orderBy("fy"), Window.partitionBy("symbol").orderBy("fy", "fp").rowsBetween(-7, 0)
    q = quarters(spark, sf_dir).withColumn("before", F.lag("rev").over(same))
    q = q.withColumn("surprise", F.col("rev") - F.col("before")).withColumn("growth", safe_div(F.col("rev"), F.col("before")) - 1)
    sd = F.when(F.count("surprise").over(run) >= 4, F.stddev_samp("surprise").over(run))
    return q.withColumn("z", safe_div(F.col("surprise"), sd))


@query("same_quarter_surprise", twin(f"SELECT symbol, fy, fp, round({_clip('growth', -1, 1)}, 6) AS growth, round({_clip('z', -4, 4)}, 5) AS sue FROM su", _Q, _FI, _QT, _YOY, _SUE))
def same_quarter_surprise(spark, sf_dir) -> DataFrame:
    return surprises(spark, sf_dir).select("symbol", "fy", "fp", r6(clip(F.col("growth"), -1.0, 1.0)).alias("growth"), F.round(clip(F.col("z"), -4.0, 4.0), 5).alias("sue"))


@query("accruals", twin(f"SELECT symbol, fy, fp, round({_clip('(rev - inc - lag(rev - inc) OVER s) / nullif((ytd + lag(ytd) OVER s) / 2, 0)', -1, 1)}, 6) + 0 AS accruals FROM qt WINDOW s AS (PARTITION BY symbol ORDER BY fy, fp)", _Q, _FI, _QT))
def accruals(spark, sf_dir) -> DataFrame:
    s = Window.partitionBy("symbol").orderBy("fy", "fp")
    gap = F.col("rev") - F.col("inc")
    return quarters(spark, sf_dir).select("symbol", "fy", "fp", r6(clip(safe_div(gap - F.lag(gap).over(s), (F.col("ytd") + F.lag("ytd").over(s)) / 2), -1.0, 1.0)).alias("accruals"))


@query("ttm_sum", twin("SELECT symbol, date, CASE WHEN count(rev) OVER r >= 4 AND rev IS NOT NULL THEN round(sum(rev) OVER r, 2) END AS ttm FROM qt WINDOW r AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 359 DAY PRECEDING AND CURRENT ROW)", _Q, _FI, _QT))
def ttm_sum(spark, sf_dir) -> DataFrame:
    """Sum over 360 calendar days up to and including the filing."""
    r = Window.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(-359, 0)
    return quarters(spark, sf_dir).select("symbol", "date", F.when((F.count("rev").over(r) >= 4) & F.col("rev").isNotNull(), F.round(F.sum("rev").over(r), 2)).alias("ttm"))


_DAYS = ("dy", "SELECT symbol, unnest(generate_series(min(date), max(date), INTERVAL 7 DAY))::DATE AS date FROM fi GROUP BY symbol")


@query("pead_drift", twin("SELECT d.symbol, d.date, round(CASE WHEN d.date - s.date BETWEEN 0 AND 90 THEN sign(z) * exp(-(d.date - s.date) / 30::DOUBLE) ELSE 0 END, 6) + 0 AS drift FROM dy d ASOF LEFT JOIN su s ON d.symbol = s.symbol AND d.date >= s.date", _Q, _FI, _QT, _YOY, _SUE, _DAYS))
def pead_drift(spark, sf_dir) -> DataFrame:
    """Sign of the last surprise, decaying over the ninety days after its filing."""
    f = filings(spark, sf_dir)
    weeks = f.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b")).select("symbol", F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("date"))
    s = surprises(spark, sf_dir).select("symbol", "date", F.col("date").alias("filed"), "z")
    d = asof_backward(weeks, s, ["symbol"], "date", ["filed", "z"])
    age = F.datediff("date", "filed")
    return d.select("symbol", "date", r6(F.when(age.between(0, 90), F.signum("z") * F.exp(-age / 30)).otherwise(0.0)).alias("drift"))


@query("valuation_z", twin(f"SELECT symbol, date, round({_clip('(x - avg(x) OVER v) / nullif(CASE WHEN count(x) OVER v >= 8 THEN stddev_samp(x) OVER v END, 0)', -4, 4)}, 5) AS z FROM (SELECT symbol, date, inc / nullif(rev, 0) AS x FROM qt) WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)", _Q, _FI, _QT))
def valuation_z(spark, sf_dir) -> DataFrame:
    q = quarters(spark, sf_dir).select("symbol", "date", safe_div(F.col("inc"), F.col("rev")).alias("x"))
    return q.select("symbol", "date", F.round(clip(w.zscore(F.col("x"), 12, 8), -4.0, 4.0), 5).alias("z"))


@query("facts_pivot", """WITH f AS (SELECT l_orderkey AS adsh, l_returnflag AS tag, arg_max(l_extendedprice, (l_shipdate, l_quantity, l_extendedprice)) AS v FROM lineitem GROUP BY ALL)
SELECT adsh, max(v) FILTER (WHERE tag = 'A') AS a, max(v) FILTER (WHERE tag = 'N') AS n, coalesce(max(v) FILTER (WHERE tag = 'R'), max(v) FILTER (WHERE tag = 'A')) AS r_or_a FROM f GROUP BY adsh""")
def facts_pivot(spark, sf_dir) -> DataFrame:
    """Newest fact per (filing, tag), pivoted, with tags tried in order."""
    at = F.struct("l_shipdate", "l_quantity", "l_extendedprice")
    f = raw(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("adsh"), F.col("l_returnflag").alias("tag")).agg(F.max_by("l_extendedprice", at).alias("v"))
    one = lambda t: F.max(F.when(F.col("tag") == t, F.col("v")))
    return f.groupBy("adsh").agg(one("A").alias("a"), one("N").alias("n"), F.coalesce(one("R"), one("A")).alias("r_or_a"))


@query("macro_spread", twin("SELECT date, round(l - s, 6) AS spread, round(l / nullif(lag(l, 7) OVER (ORDER BY date), 0) - 1, 6) AS change_7d FROM (SELECT date, last_value(lr IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS l, last_value(sr IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT ts::DATE AS date, avg(price) FILTER (WHERE event_type = 'view' AND day(ts) % 3 = 1) AS lr, avg(price) FILTER (WHERE event_type = 'click') AS sr FROM ticks GROUP BY ALL))"))
def macro_spread(spark, sf_dir) -> DataFrame:
    """Term spread on a daily spine, slow series carried forward; one row per day."""
    t = ticks(spark, sf_dir).withColumn("date", F.to_date("ts"))
    m = t.groupBy("date").agg(F.avg(F.when((F.col("event_type") == "view") & (F.dayofmonth("ts") % 3 == 1), F.col("price"))).alias("lr"), F.avg(F.when(F.col("event_type") == "click", F.col("price"))).alias("sr"))
    m = daily_spine(m.withColumn("k", F.lit(1)), ["k"], "date").select("date").join(m, "date", "left")
    days = Window.orderBy("date")
    fill = lambda c: F.last(c, ignorenulls=True).over(days.rowsBetween(Window.unboundedPreceding, 0))
    m = m.select("date", fill("lr").alias("l"), fill("sr").alias("s"))
    return m.select("date", r6(F.col("l") - F.col("s")).alias("spread"), r6(safe_div(F.col("l"), F.lag("l", 7).over(days)) - 1).alias("change_7d"))


@query("regime_observations", twin("SELECT date, round(x - lag(x, 20) OVER (ORDER BY date), 6) AS trend_20, round(CASE WHEN count(d) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN stddev_samp(d) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END, 6) AS vol_20 FROM (SELECT *, x - lag(x) OVER (ORDER BY date) AS d FROM (SELECT date, ln(avg(close)) AS x FROM bars GROUP BY date))"))
def regime_observations(spark, sf_dir) -> DataFrame:
    """Trend and volatility of the market level; one row per date."""
    m = bars(spark, sf_dir).groupBy("date").agg(F.log(F.avg("close")).alias("x"))
    days = Window.orderBy("date")
    m = m.withColumn("d", F.col("x") - F.lag("x").over(days))
    run = days.rowsBetween(-19, 0)
    return m.select("date", r6(F.col("x") - F.lag("x", 20).over(days)).alias("trend_20"), r6(F.when(F.count("d").over(run) >= 20, F.stddev_samp("d").over(run))).alias("vol_20"))
