"""Ledger reports: positions, wallets, cash flow by period and category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import r6
from ..operators.ledger import expense, income, positions
from ..registry import query
from ..sources.logical import bars, raw, trades, transactions, twin, verdicts

#: The category of the test tables that stands for investments, which are no expense.
INVESTMENT = "not specified"
_AS_OF = ("asof_", "SELECT max(tx_date) AS d FROM transactions")
_T = ("t", "SELECT *, CASE WHEN amount > 0 THEN amount ELSE 0 END AS inc, CASE WHEN amount < 0 AND category <> 'not specified' THEN -amount ELSE 0 END AS exp FROM transactions, asof_")
_POS = (("o", "SELECT *, row_number() OVER (PARTITION BY user_id, symbol ORDER BY trade_date, seq, side, quantity, price) AS rn FROM trades"),
    ("f", """SELECT user_id, symbol, rn, CASE WHEN side = 'BUY' THEN quantity ELSE 0 END AS q, CASE WHEN side = 'BUY' THEN quantity * price ELSE 0 END AS c FROM o WHERE rn = 1 UNION ALL
    SELECT o.user_id, o.symbol, o.rn, CASE WHEN side = 'BUY' THEN f.q + quantity WHEN f.q - quantity > 1e-9 THEN f.q - quantity ELSE 0 END, CASE WHEN side = 'BUY' THEN f.c + quantity * price WHEN f.q - quantity > 1e-9 THEN f.c * (1 - quantity / f.q) ELSE 0 END
    FROM f JOIN o ON o.user_id = f.user_id AND o.symbol = f.symbol AND o.rn = f.rn + 1"""), ("ps", "SELECT user_id, symbol, arg_max(q, rn) AS quantity, arg_max(c, rn) AS cost FROM f GROUP BY ALL"))


def dated(spark, sf_dir) -> DataFrame:
    """Transactions with the report date ``d``: the newest transaction, never the clock."""
    t = transactions(spark, sf_dir)
    t = t.crossJoin(F.broadcast(t.agg(F.max("tx_date").alias("d"))))  # one row
    return t.withColumn("inc", income(F.col("amount"))).withColumn("exp", expense(F.col("amount"), F.col("category"), INVESTMENT))


def r2(c):
    return F.round(c, 2)


@query("positions", twin("SELECT user_id, symbol, quantity, cost, cost / nullif(quantity, 0) AS avg_price FROM ps", *_POS, recursive=True))
def positions_q(spark, sf_dir) -> DataFrame:
    return positions(trades(spark, sf_dir))


@query("held_quantity", twin("SELECT user_id, upper(symbol) AS symbol, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS quantity FROM trades GROUP BY ALL"))
def held_quantity(spark, sf_dir) -> DataFrame:
    return trades(spark, sf_dir).groupBy("user_id", F.upper("symbol").alias("symbol")).agg(F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))).alias("quantity"))


@query("wallet", twin("SELECT user_id, round(c_acctbal, 2) AS cash, round(sum(quantity * coalesce(last, cost / nullif(quantity, 0))), 2) AS value, round(c_acctbal + sum(quantity * coalesce(last, cost / nullif(quantity, 0))), 2) AS equity FROM ps JOIN customer ON c_custkey = user_id LEFT JOIN (SELECT symbol, arg_max(close, date) AS last FROM bars GROUP BY symbol) USING (symbol) WHERE quantity > 0 GROUP BY user_id, c_acctbal", *_POS, recursive=True))
def wallet(spark, sf_dir) -> DataFrame:
    last = bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "date").alias("last"))
    cash = raw(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("cash"))
    p = positions(trades(spark, sf_dir)).where("quantity > 0").join(last, "symbol", "left")
    v = p.groupBy("user_id").agg(F.sum(F.col("quantity") * F.coalesce("last", "avg_price")).alias("value")).join(cash, "user_id")
    return v.select("user_id", r2(F.col("cash")).alias("cash"), r2(F.col("value")).alias("value"), r2(F.col("cash") + F.col("value")).alias("equity"))


@query("oversell_check", twin("SELECT user_id, symbol, min(run) AS worst FROM (SELECT user_id, symbol, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) OVER (PARTITION BY user_id, symbol ORDER BY trade_date, seq ROWS UNBOUNDED PRECEDING) AS run FROM trades) GROUP BY ALL HAVING min(run) < 0"))
def oversell_check(spark, sf_dir) -> DataFrame:
    """Ledgers whose running quantity falls below zero."""
    w = Window.partitionBy("user_id", "symbol").orderBy("trade_date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    t = trades(spark, sf_dir).withColumn("run", F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))).over(w))
    return t.groupBy("user_id", "symbol").agg(F.min("run").alias("worst")).where("worst < 0")


@query("cashflow_monthly", twin("""SELECT m AS month, round(coalesce(sum(inc), 0), 2) AS income, round(coalesce(sum(exp), 0), 2) AS expense, round(coalesce(sum(inc), 0) - coalesce(sum(exp), 0), 2) AS net FROM (SELECT unnest(generate_series(date_trunc('month', d) - INTERVAL 11 MONTH, date_trunc('month', d), INTERVAL 1 MONTH))::DATE AS m FROM asof_)
    LEFT JOIN t ON date_trunc('month', tx_date)::DATE = m GROUP BY m""", _AS_OF, _T))
def cashflow_monthly(spark, sf_dir) -> DataFrame:
    """The last twelve months, empty ones included."""
    t = dated(spark, sf_dir)
    first = F.trunc("d", "month")
    months = t.agg(F.max("d").alias("d")).select(F.explode(F.sequence(F.add_months(first, -11), first, F.expr("interval 1 month"))).alias("month"))
    sums = t.groupBy(F.trunc("tx_date", "month").alias("month")).agg(F.sum("inc").alias("i"), F.sum("exp").alias("e"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return months.join(sums, "month", "left").select("month", r2(z("i")).alias("income"), r2(z("e")).alias("expense"), r2(z("i") - z("e")).alias("net"))


@query("cashflow_weekly", twin("SELECT least(4, (day(tx_date) - 1) // 7)::INT AS week, round(sum(inc), 2) AS income, round(sum(exp), 2) AS expense FROM t WHERE date_trunc('month', tx_date) = date_trunc('month', d - INTERVAL 1 MONTH) GROUP BY ALL", _AS_OF, _T))
def cashflow_weekly(spark, sf_dir) -> DataFrame:
    """Weeks of the month before the report date."""
    t = dated(spark, sf_dir).where(F.trunc("tx_date", "month") == F.add_months(F.trunc("d", "month"), -1))
    return t.groupBy(F.least(F.lit(4), F.expr("(day(tx_date) - 1) div 7").cast("int")).alias("week")).agg(r2(F.sum("inc")).alias("income"), r2(F.sum("exp")).alias("expense"))


@query("cashflow_daily", twin("SELECT tx_date, round(sum(inc), 2) AS income, round(sum(exp), 2) AS expense, count(*)::BIGINT AS n FROM t WHERE tx_date > d - 7 GROUP BY tx_date", _AS_OF, _T))
def cashflow_daily(spark, sf_dir) -> DataFrame:
    t = dated(spark, sf_dir).where("tx_date > date_sub(d, 7)")
    return t.groupBy("tx_date").agg(r2(F.sum("inc")).alias("income"), r2(F.sum("exp")).alias("expense"), F.count(F.lit(1)).alias("n"))


@query("cashflow_ytd", twin("SELECT year(tx_date)::INT AS year, round(sum(inc), 2) AS income, round(sum(exp), 2) AS expense FROM t WHERE dayofyear(tx_date) <= dayofyear(d) GROUP BY ALL", _AS_OF, _T))
def cashflow_ytd(spark, sf_dir) -> DataFrame:
    """Year to date beside the same stretch of earlier years."""
    t = dated(spark, sf_dir).where(F.dayofyear("tx_date") <= F.dayofyear("d"))
    return t.groupBy(F.year("tx_date").alias("year")).agg(r2(F.sum("inc")).alias("income"), r2(F.sum("exp")).alias("expense"))


@query("stat_cards", twin("""SELECT user_id, round(sum(inc), 2) AS income, round(sum(exp), 2) AS spend, round(sum(CASE WHEN category = 'not specified' THEN abs(amount) ELSE 0 END), 2) AS invested, round(greatest(0, sum(inc) - sum(exp)), 2) AS savings,
    round(sum(CASE WHEN tx_date BETWEEN date_trunc('month', d - INTERVAL 1 MONTH)::DATE AND (d - INTERVAL 1 MONTH)::DATE THEN exp ELSE 0 END), 2) AS last_month_same_period FROM t GROUP BY user_id""", _AS_OF, _T))
def stat_cards(spark, sf_dir) -> DataFrame:
    before = F.col("tx_date").between(F.add_months(F.trunc("d", "month"), -1), F.add_months("d", -1))
    return dated(spark, sf_dir).groupBy("user_id").agg(
        r2(F.sum("inc")).alias("income"), r2(F.sum("exp")).alias("spend"), r2(F.sum(F.when(F.col("category") == "not specified", F.abs("amount")).otherwise(0.0))).alias("invested"), r2(F.greatest(F.lit(0.0), F.sum("inc") - F.sum("exp"))).alias("savings"),
        r2(F.sum(F.when(before, F.col("exp")).otherwise(0.0))).alias("last_month_same_period"),
    )


_NETS = (("today", "tx_date = d"), ("month", "date_trunc('month', tx_date) = date_trunc('month', d)"), ("year_365", "tx_date > d - 365"), ("prior_365", "tx_date <= d - 365 AND tx_date > d - 730"))


@query("period_nets", twin("SELECT " + ", ".join(f"round(sum(CASE WHEN {c} THEN amount ELSE 0 END), 2) AS net_{n}" for n, c in _NETS) + " FROM t", _AS_OF, _T))
def period_nets(spark, sf_dir) -> DataFrame:
    when = {"today": "tx_date = d", "month": "trunc(tx_date, 'month') = trunc(d, 'month')", "year_365": "tx_date > date_sub(d, 365)", "prior_365": "tx_date <= date_sub(d, 365) and tx_date > date_sub(d, 730)"}
    return dated(spark, sf_dir).agg(*[r2(F.sum(F.when(F.expr(c), F.col("amount")).otherwise(0.0))).alias(f"net_{n}") for n, c in when.items()])


_CAT = "sum(CASE WHEN category = '{}' THEN exp ELSE 0 END)"


@query("category_groups", twin(f"""SELECT account, round(sum(exp), 2) AS total, round(CASE WHEN u > 0 THEN u WHEN h > 0 THEN h ELSE 0 END, 2) AS needs_first_alias, round(u + h, 2) AS needs_sum, round(100 * (u + h) / nullif(sum(exp), 0), 4) AS needs_pct, round(100 - 100 * (u + h) / nullif(sum(exp), 0), 4) AS other_pct
    FROM (SELECT account, exp, {_CAT.format('urgent')} OVER (PARTITION BY account) AS u, {_CAT.format('high')} OVER (PARTITION BY account) AS h FROM t WHERE tx_date > d - 30) GROUP BY account, u, h""", _AS_OF, _T))
def category_groups(spark, sf_dir) -> DataFrame:
    """Spending of 30 days by group; ``first_alias`` counts only the first alias that has spending, ``sum`` counts all."""
    t = dated(spark, sf_dir).where("tx_date > date_sub(d, 30)")
    part = lambda c: F.sum(F.when(F.col("category") == c, F.col("exp")).otherwise(0.0))
    g = t.groupBy("account").agg(F.sum("exp").alias("total"), part("urgent").alias("u"), part("high").alias("h"))
    share = 100 * (F.col("u") + F.col("h")) / F.nullif("total", F.lit(0.0))
    return g.select("account", r2(F.col("total")).alias("total"), r2(F.when(F.col("u") > 0, F.col("u")).when(F.col("h") > 0, F.col("h")).otherwise(0.0)).alias("needs_first_alias"), r2(F.col("u") + F.col("h")).alias("needs_sum"), F.round(share, 4).alias("needs_pct"), F.round(100 - share, 4).alias("other_pct"))


@query("heatmap", twin("SELECT tx_date, round(spend, 2) AS spend, least(4, floor(4 * ln(1 + spend) / nullif(ln(1 + max(spend) OVER ()), 0)))::INT AS level FROM (SELECT tx_date, sum(exp) AS spend FROM t WHERE tx_date > d - 90 GROUP BY tx_date)", _AS_OF, _T))
def heatmap(spark, sf_dir) -> DataFrame:
    days = dated(spark, sf_dir).where("tx_date > date_sub(d, 90)").groupBy("tx_date").agg(F.sum("exp").alias("spend"))
    top = F.broadcast(days.agg(F.max("spend").alias("top")))  # one row
    return days.crossJoin(top).select("tx_date", r2(F.col("spend")).alias("spend"), F.least(F.lit(4), F.floor(4 * F.log1p("spend") / F.nullif(F.log1p("top"), F.lit(0.0)))).cast("int").alias("level"))


_DAYS = (
    ("dy", "SELECT account, unnest(generate_series(d - INTERVAL 29 DAY, d, INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT account FROM transactions), asof_"),
    ("sp", "SELECT dy.account, day, coalesce(sum(-amount) FILTER (WHERE amount < 0), 0) AS spend FROM dy LEFT JOIN transactions x ON x.account = dy.account AND tx_date = day GROUP BY ALL"),
)


def daily_spend(spark, sf_dir, days: int = 30) -> DataFrame:
    """account, day, spend of the last ``days`` days up to the report date, those without a transaction included."""
    t = transactions(spark, sf_dir)
    last = F.broadcast(t.agg(F.max("tx_date").alias("d")))  # one row
    spine = t.select("account").distinct().crossJoin(last).select("account", F.explode(F.sequence(F.date_sub("d", days - 1), F.col("d"))).alias("day"))
    spent = t.where("amount < 0").groupBy("account", F.col("tx_date").alias("day")).agg(F.sum(-F.col("amount")).alias("spend"))
    return spine.join(spent, ["account", "day"], "left").withColumn("spend", F.coalesce("spend", F.lit(0.0)))


@query("heat_levels", twin("SELECT account, day, round(spend, 2) AS spend, CASE WHEN spend > 0 THEN greatest(1, ceil(ln(1 + spend) / ln(1 + greatest(max(spend) OVER (PARTITION BY account), 1)) * 4 - 1e-9::DOUBLE))::INT ELSE 0 END AS level FROM sp", _AS_OF, *_DAYS))
def heat_levels(spark, sf_dir) -> DataFrame:
    """Heat of each account's last thirty days in four steps of the logarithm; a day without spending has none, the largest the fourth."""
    top = F.greatest(F.max("spend").over(Window.partitionBy("account")), F.lit(1.0))
    level = F.greatest(F.lit(1), F.ceil(F.log1p("spend") / F.log1p(top) * 4 - 1e-9))
    return daily_spend(spark, sf_dir).select("account", "day", r2(F.col("spend")).alias("spend"), F.when(F.col("spend") > 0, level).otherwise(0).cast("int").alias("level"))


@query("spend_trend", twin("""SELECT account, round(a, 2) AS first_half, round(b, 2) AS second_half, CASE WHEN b > a * 1.1::DOUBLE THEN 'rising' WHEN b < a * 0.9::DOUBLE THEN 'falling' ELSE 'stable' END AS trend FROM (
  SELECT account, coalesce(sum(spend) FILTER (WHERE day <= d - 15), 0) AS a, coalesce(sum(spend) FILTER (WHERE day > d - 15), 0) AS b FROM sp, asof_ GROUP BY account)""", _AS_OF, *_DAYS))
def spend_trend(spark, sf_dir) -> DataFrame:
    """The last fifteen days against the fifteen before, a tenth more or less counts."""
    days = daily_spend(spark, sf_dir).withColumn("back", F.datediff(F.max("day").over(Window.partitionBy("account")), "day"))
    half = lambda on: F.sum(F.when(on, F.col("spend")).otherwise(0.0))
    h = days.groupBy("account").agg(half(F.col("back") >= 15).alias("a"), half(F.col("back") < 15).alias("b"))
    trend = F.when(F.col("b") > F.col("a") * 1.1, "rising").when(F.col("b") < F.col("a") * 0.9, "falling").otherwise("stable")
    return h.select("account", r2(F.col("a")).alias("first_half"), r2(F.col("b")).alias("second_half"), trend.alias("trend"))


@query("top_categories", twin("SELECT user_id, category, round(spend, 2) AS spend, round(100 * (inc - total) / nullif(inc, 0), 4) AS savings_rate FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY spend DESC, category) AS k FROM (SELECT user_id, category, sum(exp) AS spend, sum(sum(inc)) OVER (PARTITION BY user_id) AS inc, sum(sum(exp)) OVER (PARTITION BY user_id) AS total FROM t GROUP BY user_id, category) WHERE spend > 0) WHERE k <= 5", _AS_OF, _T))
def top_categories(spark, sf_dir) -> DataFrame:
    """The five largest categories of a user's spending, with the share of income that is saved."""
    s = dated(spark, sf_dir).groupBy("user_id", "category").agg(F.sum("exp").alias("spend"), F.sum("inc").alias("inc"))
    user = Window.partitionBy("user_id")
    s = s.withColumns({"total": F.sum("spend").over(user), "earned": F.sum("inc").over(user)}).where("spend > 0")
    k = F.row_number().over(user.orderBy(F.desc("spend"), "category"))
    saved = F.round(100 * (F.col("earned") - F.col("total")) / F.nullif("earned", F.lit(0.0)), 4)
    return s.withColumn("k", k).where("k <= 5").select("user_id", "category", r2(F.col("spend")).alias("spend"), saved.alias("savings_rate"))


@query("diversification", twin("SELECT user_id, round((1 - sum(w * w)) * 100)::INT AS score, CASE WHEN round((1 - sum(w * w)) * 100) >= 75 THEN 'strong' WHEN round((1 - sum(w * w)) * 100) >= 50 THEN 'moderate' ELSE 'concentrated' END AS label FROM (SELECT user_id, cost / sum(cost) OVER (PARTITION BY user_id) AS w FROM ps WHERE cost > 0) GROUP BY user_id", *_POS, recursive=True))
def diversification(spark, sf_dir) -> DataFrame:
    """One minus the sum of squared weights, as a score of 100."""
    p = positions(trades(spark, sf_dir)).where("cost > 0").select("user_id", (F.col("cost") / F.sum("cost").over(Window.partitionBy("user_id"))).alias("w"))
    s = p.groupBy("user_id").agg(F.round((1 - F.sum(F.col("w") * F.col("w"))) * 100).cast("int").alias("score"))
    return s.withColumn("label", F.when(F.col("score") >= 75, "strong").when(F.col("score") >= 50, "moderate").otherwise("concentrated"))


@query("insight_mix", twin("SELECT symbol, count(*)::BIGINT AS n, round(avg(llm_confidence), 4) AS confidence, CASE WHEN sum((sentiment = 'bullish')::INT) > 1.5 * sum((sentiment = 'bearish')::INT) THEN 'bullish' WHEN sum((sentiment = 'bearish')::INT) > 1.5 * sum((sentiment = 'bullish')::INT) THEN 'bearish' ELSE 'mixed' END AS mood, max(generated_at) AS latest FROM verdicts GROUP BY symbol"))
def insight_mix(spark, sf_dir) -> DataFrame:
    up, down = (F.sum((F.col("sentiment") == s).cast("int")) for s in ("bullish", "bearish"))
    return verdicts(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("llm_confidence"), 4).alias("confidence"), F.when(up > 1.5 * down, "bullish").when(down > 1.5 * up, "bearish").otherwise("mixed").alias("mood"), F.max("generated_at").alias("latest"))


@query("headroom", twin("SELECT account, least(100, round(100 * sum(exp) / 5000000))::INT AS used_pct, round(greatest(0, 5000000 - sum(exp)), 2) AS available FROM t WHERE date_trunc('month', tx_date) = date_trunc('month', d) OR tx_date > d - 31 GROUP BY account", _AS_OF, _T))
def headroom(spark, sf_dir) -> DataFrame:
    """Share of a monthly limit that is used."""
    t = dated(spark, sf_dir).where("trunc(tx_date, 'month') = trunc(d, 'month') or tx_date > date_sub(d, 31)")
    return t.groupBy("account").agg(F.least(F.lit(100), F.round(100 * F.sum("exp") / 5000000)).cast("int").alias("used_pct"), r2(F.greatest(F.lit(0.0), 5000000 - F.sum("exp"))).alias("available"))


@query("account_balances", twin("SELECT account, round(1000 + sum(amount), 2) AS balance, round(sum(CASE WHEN date_trunc('month', tx_date) = date_trunc('month', d) THEN amount ELSE 0 END), 2) AS month_sum FROM t GROUP BY account", _AS_OF, _T))
def account_balances(spark, sf_dir) -> DataFrame:
    t = dated(spark, sf_dir)
    return t.groupBy("account").agg(r2(1000 + F.sum("amount")).alias("balance"), r2(F.sum(F.when(F.expr("trunc(tx_date, 'month') = trunc(d, 'month')"), F.col("amount")).otherwise(0.0))).alias("month_sum"))


@query("ledger_density", twin("SELECT strftime(tx_date, '%Y-%m') AS month, count(*)::BIGINT AS n, round(sum(amount), 0) AS total FROM transactions GROUP BY ALL"))
def ledger_density(spark, sf_dir) -> DataFrame:
    return transactions(spark, sf_dir).groupBy(F.date_format("tx_date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 0).alias("total"))


@query("blended_move", twin("SELECT user_id, round(sum(value * chg) / nullif(sum(value), 0), 6) AS move FROM (SELECT user_id, quantity * last AS value, chg FROM ps JOIN (SELECT symbol, arg_max(close, date) AS last, arg_max(c, date) AS chg FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS c FROM bars) GROUP BY symbol) USING (symbol)) GROUP BY user_id", *_POS, recursive=True))
def blended_move(spark, sf_dir) -> DataFrame:
    """Value-weighted latest move of each user's positions."""
    w = Window.partitionBy("symbol").orderBy("date")
    b = bars(spark, sf_dir).withColumn("c", F.try_divide("close", F.lag("close").over(w)) - 1).groupBy("symbol").agg(F.max_by("close", "date").alias("last"), F.max_by("c", "date").alias("chg"))
    p = positions(trades(spark, sf_dir)).join(b, "symbol").withColumn("value", F.col("quantity") * F.col("last"))
    return p.groupBy("user_id").agg(r6(F.sum(F.col("value") * F.col("chg")) / F.nullif(F.sum("value"), F.lit(0.0))).alias("move"))


@query("days_until_due", "SELECT c_custkey AS id, CASE WHEN due >= 14 THEN due - 14 ELSE day(last_day(DATE '2024-02-14')) - 14 + due END::INT AS days FROM (SELECT c_custkey, (c_custkey % 28 + 1)::INT AS due FROM customer)")
def days_until_due(spark, sf_dir) -> DataFrame:
    """Days from 14 February 2024 to the next monthly due day."""
    today = F.lit("2024-02-14").cast("date")
    due = (F.col("c_custkey") % 28 + 1).cast("int")
    return raw(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(due >= F.dayofmonth(today), due - F.dayofmonth(today)).otherwise(F.dayofmonth(F.last_day(today)) - F.dayofmonth(today) + due).cast("int").alias("days"))
