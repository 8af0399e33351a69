"""Store reads: scans, latest rows, joins of predictions with outcomes, screens and searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import half_up, r6
from ..operators.asof import asof_backward, asof_forward, daily_spine, keep_last, latest_per_group
from ..operators.ledger import positions, valued
from ..registry import query
from ..sources.logical import bars, news, outcomes, predictions, raw, ticks, transactions, trades, twin, verdicts
from .cashflow import _POS

_PCOLS = "id, symbol, generated_at, prob_up, meta_prob, act, confidence, regime, target_date"


@query("history_summary", twin("SELECT symbol, count(*)::BIGINT AS rows, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY symbol"))
def history_summary(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("universe_having", twin("SELECT symbol, count(*)::BIGINT AS rows FROM bars WHERE symbol NOT IN ('Brand#1', 'Brand#2') GROUP BY symbol HAVING count(*) >= 350"))
def universe_having(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).where(~F.col("symbol").isin("Brand#1", "Brand#2")).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")).where("rows >= 350")


@query("range_scan", twin("SELECT symbol, date, close FROM bars WHERE symbol IN ('Brand#3', 'Brand#7') AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"))
def range_scan(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).where(F.col("symbol").isin("Brand#3", "Brand#7") & F.col("date").between("1997-01-01", "1998-12-31")).select("symbol", "date", "close")


@query("daily_tail", twin("SELECT symbol, date, close, volume FROM bars WHERE symbol = 'Brand#3' ORDER BY date DESC LIMIT 30"))
def daily_tail(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).where("symbol = 'Brand#3'").orderBy(F.desc("date")).limit(30).orderBy("date").select("symbol", "date", "close", "volume")


@query("latest_snapshots", twin("SELECT id, symbol, ts, price FROM ticks ORDER BY ts DESC, id DESC LIMIT 50"))
def latest_snapshots(spark, sf_dir) -> DataFrame:
    return ticks(spark, sf_dir).orderBy(F.desc("ts"), F.desc("id")).limit(50).select("id", "symbol", "ts", "price")


@query("latest_per_symbol", twin(f"SELECT {_PCOLS} FROM predictions p WHERE generated_at = (SELECT max(generated_at) FROM predictions q WHERE q.symbol = p.symbol)"))
def latest_per_symbol(spark, sf_dir) -> DataFrame:
    return latest_per_group(predictions(spark, sf_dir), ["symbol"], "generated_at").select(*_PCOLS.split(", "))


@query("latest_verdict_filtered", twin("SELECT id, symbol, generated_at, label, llm_confidence FROM verdicts v WHERE insight_type = 'verdict' AND generated_at = (SELECT max(generated_at) FROM verdicts q WHERE q.symbol = v.symbol AND q.insight_type = 'verdict')"))
def latest_verdict_filtered(spark, sf_dir) -> DataFrame:
    return latest_per_group(verdicts(spark, sf_dir).where("insight_type = 'verdict'"), ["symbol"], "generated_at").select("id", "symbol", "generated_at", "label", "llm_confidence")


@query("prediction_history", twin("SELECT p.id, p.symbol, p.generated_at, p.confidence, o.actual_return, o.correct FROM predictions p LEFT JOIN outcomes o ON o.prediction_id = p.id"))
def prediction_history(spark, sf_dir) -> DataFrame:
    p, o = predictions(spark, sf_dir), outcomes(spark, sf_dir)
    return p.join(o, p["id"] == o["prediction_id"], "left").select("id", "symbol", "generated_at", "confidence", "actual_return", "correct")


@query("resolved_outcomes", twin("SELECT p.id, p.symbol, p.confidence, p.meta_prob, o.correct, o.in_band FROM outcomes o JOIN predictions p ON o.prediction_id = p.id"))
def resolved_outcomes(spark, sf_dir) -> DataFrame:
    p, o = predictions(spark, sf_dir), outcomes(spark, sf_dir)
    return o.join(p, p["id"] == o["prediction_id"]).select("id", "symbol", "confidence", "meta_prob", "correct", "in_band")


@query("due_predictions", twin(f"SELECT {_PCOLS} FROM predictions p WHERE target_date IS NOT NULL AND target_date <= DATE '2024-01-20' AND NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.prediction_id = p.id)"))
def due_predictions(spark, sf_dir) -> DataFrame:
    p = predictions(spark, sf_dir).where("target_date is not null and target_date <= date'2024-01-20'")
    o = outcomes(spark, sf_dir)
    return p.join(o, p["id"] == o["prediction_id"], "left_anti").select(*_PCOLS.split(", "))


@query("unscored_news", twin("SELECT url, symbol, title FROM news WHERE score IS NULL"))
def unscored_news(spark, sf_dir) -> DataFrame:
    labels = raw(spark, sf_dir, "labels").select(F.col("doc_id").alias("url"))
    return news(spark, sf_dir).select("url", "symbol", "title").join(labels, "url", "left_anti")


@query("top_movers", twin("SELECT symbol, date, round(change, 6) AS change FROM (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS change FROM bars) WHERE change IS NOT NULL ORDER BY abs(change) DESC, symbol, date LIMIT 6"))
def top_movers(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    b = bars(spark, sf_dir).select("symbol", "date", (F.try_divide("close", F.lag("close").over(w)) - 1).alias("change")).where("change is not null")
    return b.orderBy(F.desc(F.abs("change")), "symbol", "date").limit(6).select("symbol", "date", r6(F.col("change")).alias("change"))


@query("market_highlights", twin("""SELECT symbol, kind, price FROM (SELECT *, row_number() OVER (ORDER BY kind_order, rn) AS pos FROM (SELECT *, CASE WHEN kind = 'stock' THEN 0 ELSE 1 END AS kind_order, row_number() OVER (PARTITION BY kind ORDER BY price DESC, id) AS rn
    FROM (SELECT id, symbol, price, CASE WHEN event_type = 'purchase' THEN 'stock' ELSE 'crypto' END AS kind FROM ticks)) WHERE kind = 'crypto' OR rn <= 2) WHERE pos <= 4"""))
def market_highlights(spark, sf_dir) -> DataFrame:
    """Two stocks at most, then cryptos up to four."""
    t = ticks(spark, sf_dir).select("id", "symbol", "price", F.when(F.col("event_type") == "purchase", "stock").otherwise("crypto").alias("kind"))
    top = lambda kind, n: t.where(F.col("kind") == kind).orderBy(F.desc("price"), "id").limit(n)
    return top("stock", 2).unionByName(top("crypto", 4)).orderBy(F.desc("kind"), F.desc("price"), "id").limit(4).select("symbol", "kind", "price")


@query("screener", twin("SELECT symbol, date, round(change, 6) AS change FROM (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS change FROM bars) WHERE change >= 0 AND contains(lower(symbol), 'brand#1')"))
def screener(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    b = bars(spark, sf_dir).where(F.lower("symbol").contains("brand#1"))
    b = b.select("symbol", "date", (F.try_divide("close", F.lag("close").over(w)) - 1).alias("change")).where("change >= 0")  # before rounding: a small loss is no gain
    return b.withColumn("change", r6(F.col("change")))


@query("tx_search_sort", twin("SELECT id, tx_date, amount, category FROM transactions WHERE contains(lower(title), '77') AND category = 'high' ORDER BY abs(amount) DESC, id LIMIT 40"))
def tx_search_sort(spark, sf_dir) -> DataFrame:
    t = transactions(spark, sf_dir).where(F.lower("title").contains("77") & (F.col("category") == "high"))
    return t.orderBy(F.desc(F.abs("amount")), "id").limit(40).select("id", "tx_date", "amount", "category")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("table_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*)::BIGINT AS rows FROM {n}" for n in TABLES))
def table_counts(spark, sf_dir) -> DataFrame:
    """Rows of every table."""
    one = lambda n: raw(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows")
    return reduce(DataFrame.unionByName, map(one, TABLES))


@query("safe_accounts", "SELECT c_custkey AS id, c_name AS name, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0::DOUBLE) AS balance FROM customer")
def safe_accounts(spark, sf_dir) -> DataFrame:
    return raw(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.lit(0.0)).alias("balance"))


@query("symbol_whitelist", twin("SELECT DISTINCT symbol FROM ticks WHERE regexp_matches(symbol, '^[A-Z0-9.\\-]{1,12}$') AND symbol <> 'S0'"))
def symbol_whitelist(spark, sf_dir) -> DataFrame:
    return ticks(spark, sf_dir).where(F.col("symbol").rlike(r"^[A-Z0-9.\-]{1,12}$") & (F.col("symbol") != "S0")).select("symbol").distinct()


@query("keep_last_per_key", twin("SELECT symbol, day, id, price FROM (SELECT symbol, ts::DATE AS day, id, price, row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY ts DESC, id DESC) AS n FROM ticks) WHERE n = 1"))
def keep_last_per_key(spark, sf_dir) -> DataFrame:
    t = ticks(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return keep_last(t, ["symbol", "day"], [F.desc("ts"), F.desc("id")]).select("symbol", "day", "id", "price")


_MACRO = ("macro", "SELECT ts::DATE AS date, symbol, arg_max(price, (ts, id)) AS level FROM ticks WHERE event_type = 'signup' GROUP BY ALL")
_PANEL = ("panel", "SELECT symbol, ts::DATE AS date, sum(price) AS v FROM ticks GROUP BY ALL")


def _macro(spark, sf_dir) -> DataFrame:
    return ticks(spark, sf_dir).where("event_type = 'signup'").groupBy(F.to_date("ts").alias("date"), "symbol").agg(F.max_by("price", F.struct("ts", "id")).alias("level"))


def _panel(spark, sf_dir) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("date")).agg(F.sum("price").alias("v"))


@query("asof_macro", twin("SELECT p.symbol, p.date, m.level FROM panel p ASOF LEFT JOIN macro m ON p.symbol = m.symbol AND p.date >= m.date", _MACRO, _PANEL))
def asof_macro(spark, sf_dir) -> DataFrame:
    return asof_backward(_panel(spark, sf_dir), _macro(spark, sf_dir), ["symbol"], "date", ["level"]).select("symbol", "date", "level")


@query("asof_strict", twin("SELECT p.symbol, p.date, m.level FROM panel p ASOF LEFT JOIN macro m ON p.symbol = m.symbol AND p.date > m.date", _MACRO, _PANEL))
def asof_strict(spark, sf_dir) -> DataFrame:
    return asof_backward(_panel(spark, sf_dir), _macro(spark, sf_dir), ["symbol"], "date", ["level"], strict=True).select("symbol", "date", "level")


@query("asof_limit5", twin("""SELECT symbol, date, CASE WHEN sum((date <> source)::INT) OVER (PARTITION BY symbol, source ORDER BY date ROWS UNBOUNDED PRECEDING) <= 2 THEN level END AS level
    FROM (SELECT p.symbol, p.date, m.date AS source, m.level FROM panel p ASOF LEFT JOIN macro m ON p.symbol = m.symbol AND p.date >= m.date)""", ("macro", "SELECT * FROM (SELECT ts::DATE AS date, symbol, arg_max(price, (ts, id)) AS level FROM ticks WHERE event_type = 'signup' GROUP BY ALL) WHERE day(date) % 7 = 1"), _PANEL))
def asof_limit5(spark, sf_dir) -> DataFrame:
    """A slow series carried forward to at most two later rows of each source row."""
    slow = _macro(spark, sf_dir).where(F.dayofmonth("date") % 7 == 1)
    return asof_backward(_panel(spark, sf_dir), slow, ["symbol"], "date", ["level"], limit=2).select("symbol", "date", "level")


@query("asof_forward_close", twin("SELECT p.symbol, p.id, b.close FROM (SELECT DISTINCT 'Brand#' || (id % 25 + 1)::VARCHAR AS symbol, id, (DATE '1996-01-01' + (id % 1500)::INT)::DATE AS date FROM ticks) p ASOF LEFT JOIN bars b ON p.symbol = b.symbol AND p.date <= b.date"))
def asof_forward_close(spark, sf_dir) -> DataFrame:
    p = ticks(spark, sf_dir).select(F.concat(F.lit("Brand#"), (F.col("id") % 25 + 1).cast("string")).alias("symbol"), "id", F.date_add(F.lit("1996-01-01").cast("date"), (F.col("id") % 1500).cast("int")).alias("date"))
    return asof_forward(p, bars(spark, sf_dir).select("symbol", "date", "close"), ["symbol"], "date", ["close"]).select("symbol", "id", "close")


@query("last_close_before", twin("SELECT t.user_id, t.symbol, t.trade_date AS date, b.close FROM (SELECT DISTINCT user_id, symbol, trade_date FROM trades) t ASOF LEFT JOIN bars b ON t.symbol = b.symbol AND t.trade_date >= b.date"))
def last_close_before(spark, sf_dir) -> DataFrame:
    t = trades(spark, sf_dir).select("user_id", "symbol", F.col("trade_date").alias("date")).distinct()
    return asof_backward(t, bars(spark, sf_dir).select("symbol", "date", "close"), ["symbol"], "date", ["close"]).select("user_id", "symbol", "date", "close")


@query("spine_ffill", twin("""SELECT symbol, date, last_value(level IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS level FROM (
    SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM macro GROUP BY symbol)) LEFT JOIN macro USING (symbol, date)""", _MACRO))
def spine_ffill(spark, sf_dir) -> DataFrame:
    m = _macro(spark, sf_dir)
    out = daily_spine(m, ["symbol"], "date").join(m, ["symbol", "date"], "left")
    return out.select("symbol", "date", F.last("level", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("level"))


@query("nearest_strike", twin("""SELECT symbol, arg_min(id, (abs(price - 50), id)) AS id, arg_min(price, (abs(price - 50), id)) AS strike FROM ticks GROUP BY symbol"""))
def nearest_strike(spark, sf_dir) -> DataFrame:
    near = F.struct(F.abs(F.col("price") - 50), "id")
    return ticks(spark, sf_dir).groupBy("symbol").agg(F.min_by("id", near).alias("id"), F.min_by("price", near).alias("strike"))


@query("precedence_union", twin("""SELECT symbol, date, coalesce(d.v, h.v) AS v FROM (SELECT symbol, ts::DATE AS date, max(price) AS v FROM ticks WHERE event_type = 'view' GROUP BY ALL) h
    FULL JOIN (SELECT symbol, ts::DATE AS date, max(price) AS v FROM ticks WHERE event_type = 'click' GROUP BY ALL) d USING (symbol, date)"""))
def precedence_union(spark, sf_dir) -> DataFrame:
    """Two stores of one series; the second wins where both have the day."""
    t = ticks(spark, sf_dir).withColumn("date", F.to_date("ts"))
    part = lambda kind, p: t.where(F.col("event_type") == kind).groupBy("symbol", "date").agg(F.max("price").alias("v")).withColumn("_p", F.lit(p))
    return part("view", 0).unionByName(part("click", 1)).groupBy("symbol", "date").agg(F.max_by("v", "_p").alias("v"))


@query("key_intersect_except", twin("SELECT symbol, 'both' AS side FROM (SELECT symbol FROM ticks WHERE event_type = 'view' AND price > 150 INTERSECT SELECT symbol FROM ticks WHERE event_type = 'click' AND price > 150) UNION ALL SELECT symbol, 'first' FROM (SELECT symbol FROM ticks WHERE event_type = 'view' AND price > 150 EXCEPT SELECT symbol FROM ticks WHERE event_type = 'click' AND price > 150)"))
def key_intersect_except(spark, sf_dir) -> DataFrame:
    t = ticks(spark, sf_dir).where("price > 150")
    a, b = t.where("event_type = 'view'").select("symbol"), t.where("event_type = 'click'").select("symbol")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.distinct().join(b, "symbol", "left_anti").withColumn("side", F.lit("first")))


@query("even_subsample", twin("SELECT symbol, date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS n, count(*) OVER (PARTITION BY symbol) AS m FROM bars) WHERE m <= 40 OR floor((ceil(n * 39 / (m - 1)::DOUBLE)) * (m - 1) / 39::DOUBLE) = n"))
def even_subsample(spark, sf_dir) -> DataFrame:
    """At most forty rows of each symbol, evenly spaced from the first to the last: the places floor(i (m - 1) / 39)."""
    w = Window.partitionBy("symbol")
    b = bars(spark, sf_dir).withColumns({"n": F.row_number().over(w.orderBy("date")) - 1, "m": F.count(F.lit(1)).over(w)})
    step = F.ceil(F.col("n") * 39 / (F.col("m") - 1))
    return b.where((F.col("m") <= 40) | (F.floor(step * (F.col("m") - 1) / 39) == F.col("n"))).select("symbol", "date", "close")


_FX = "(VALUES ('USD', 83.2::DOUBLE), ('INR', 1::DOUBLE)) x(currency, rate)"
_CUR = "CASE ascii(right(symbol, 1)) % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'INR' ELSE 'EUR' END"


@query("holdings_mtm", twin(f"""SELECT user_id, symbol, quantity, round(quantity * last * rate, 2) AS value, round(100 * quantity * last * rate / nullif(sum(quantity * last * rate) OVER (PARTITION BY user_id), 0), 4) AS weight, round(100 * (quantity * last * rate - cost) / nullif(cost, 0), 4) AS pnl_pct
    FROM (SELECT *, {_CUR} AS currency FROM ps WHERE quantity > 1e-9) LEFT JOIN {_FX} USING (currency) LEFT JOIN (SELECT symbol, arg_max(close, date) AS last FROM bars GROUP BY symbol) USING (symbol)""", *_POS, recursive=True))
def holdings_mtm(spark, sf_dir) -> DataFrame:
    """Average-cost positions at the last close, in the home currency; what has no quote or no exchange rate stays unpriced."""
    last = bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "date").alias("last"))
    at = F.ascii(F.right("symbol", F.lit(1))) % 3
    h = positions(trades(spark, sf_dir)).withColumn("currency", F.when(at == 0, "USD").when(at == 1, "INR").otherwise("EUR"))
    fx = spark.createDataFrame([("USD", 83.2), ("INR", 1.0)], "currency string, rate double")
    v = valued(h, last, fx)
    return v.select("user_id", "symbol", "quantity", half_up(F.col("value"), 2).alias("value"), F.round("weight", 4).alias("weight"), F.round("pnl_pct", 4).alias("pnl_pct"))


@query("catalogue_union", twin("SELECT symbol, event_type AS kind, max(ts) AS last_ts FROM ticks GROUP BY ALL UNION ALL SELECT s, 'index', NULL FROM (SELECT unnest(['S1', 'IDX']) AS s) WHERE s NOT IN (SELECT symbol FROM ticks)"))
def catalogue_union(spark, sf_dir) -> DataFrame:
    t = ticks(spark, sf_dir)
    extra = spark.createDataFrame([("S1",), ("IDX",)], "symbol string").join(t.select("symbol").distinct(), "symbol", "left_anti")
    return t.groupBy("symbol", F.col("event_type").alias("kind")).agg(F.max("ts").alias("last_ts")).unionByName(extra.select("symbol", F.lit("index").alias("kind"), F.lit(None).cast(t.schema["ts"].dataType).alias("last_ts")))
