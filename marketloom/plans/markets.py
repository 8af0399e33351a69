"""Quotes, options, order checks, jobs and further market reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import r6, safe_div
from ..operators import windows as w
from ..operators.evaluation import auc, drift
from ..operators.recursive import smooth
from ..operators.throttle import runs_apart
from ..registry import query
from ..sources.files import KeyedTable, scratch
from ..sources.logical import bars, predictions, raw, ticks, transactions, twin, verdicts
from .learning import _BIN, _RES, resolved

_W = "(PARTITION BY symbol ORDER BY date"
_RET = f"ln(close / lag(close) OVER {_W}))"


@query("quote_lookup", """WITH t AS (SELECT 'S' || (user_id % 20)::VARCHAR AS symbol, event_type, value AS price, ts, event_id FROM events), q AS (SELECT upper(symbol) AS k, 0 AS p, arg_max(price, (ts, event_id)) AS price FROM t WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT upper(symbol), 1, arg_max(price, (ts, event_id)) FROM t WHERE event_type = 'view' GROUP BY 1)
SELECT c_custkey AS id, arg_min(CASE WHEN price <> 0 THEN price END, p) AS price FROM customer JOIN q ON q.k = 'S' || (c_custkey % 25)::VARCHAR GROUP BY 1""")
def quote_lookup(spark, sf_dir) -> DataFrame:
    """Holdings against two quote pools by upper-case key; the first pool wins, a zero price is none."""
    t = ticks(spark, sf_dir)
    pool = lambda kind, p: t.where(F.col("event_type") == kind).groupBy(F.upper("symbol").alias("k")).agg(F.max_by("price", F.struct("ts", "id")).alias("price")).withColumn("p", F.lit(p))
    h = raw(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("S"), (F.col("c_custkey") % 25).cast("string")).alias("k"))
    return h.join(pool("click", 0).unionByName(pool("view", 1)), "k").groupBy("id").agg(F.min_by(F.when(F.col("price") != 0, F.col("price")), "p").alias("price"))


@query("options_iv", twin("""SELECT symbol, date, spot, round((c.iv + p.iv) / 2, 6) AS atm_iv, round(p.iv - c.iv, 6) AS skew FROM
    (SELECT symbol, ts::DATE AS date, max(price) / 2 AS spot FROM ticks GROUP BY ALL) s
    JOIN (SELECT t.symbol, ts::DATE AS date, arg_min(price / 100, (abs(price - sp), id)) AS iv FROM ticks t JOIN (SELECT symbol, ts::DATE AS d, max(price) / 2 AS sp FROM ticks GROUP BY ALL) x ON x.symbol = t.symbol AND x.d = t.ts::DATE WHERE event_type IN ('click', 'view') AND price > 1 AND price < 500 GROUP BY ALL) c USING (symbol, date)
    JOIN (SELECT t.symbol, ts::DATE AS date, arg_min(price / 100, (abs(price - sp), id)) AS iv FROM ticks t JOIN (SELECT symbol, ts::DATE AS d, max(price) / 2 AS sp FROM ticks GROUP BY ALL) x ON x.symbol = t.symbol AND x.d = t.ts::DATE WHERE event_type IN ('signup', 'error') AND price > 1 AND price < 500 GROUP BY ALL) p USING (symbol, date)"""))
def options_iv(spark, sf_dir) -> DataFrame:
    """Volatility nearest the money on either side of a chain, after dropping illiquid or absurd quotes."""
    t = ticks(spark, sf_dir).withColumn("date", F.to_date("ts"))
    spot = t.groupBy("symbol", "date").agg((F.max("price") / 2).alias("spot"))
    t = t.where("price > 1 and price < 500").join(spot, ["symbol", "date"]).withColumn("near", F.struct(F.abs(F.col("price") - F.col("spot")), "id"))
    side = lambda *kinds: F.min_by(F.when(F.col("event_type").isin(*kinds), F.col("price") / 100), F.when(F.col("event_type").isin(*kinds), F.col("near")))
    s = t.groupBy("symbol", "date", "spot").agg(side("click", "view").alias("c"), side("signup", "error").alias("p")).where("c is not null and p is not null")
    return s.select("symbol", "date", "spot", r6((F.col("c") + F.col("p")) / 2).alias("atm_iv"), r6(F.col("p") - F.col("c")).alias("skew"))


_SEED = f"""d AS (SELECT symbol, date, close - lag(close) OVER {_W}) AS x, row_number() OVER {_W}) - 1 AS rn FROM bars),
f AS (SELECT symbol, 14::BIGINT AS rn, avg(greatest(x, 0)) AS g, avg(greatest(-x, 0)) AS l FROM d WHERE rn BETWEEN 1 AND 14 GROUP BY symbol
  UNION ALL SELECT d.symbol, d.rn, (f.g * 13 + greatest(x, 0)) / 14, (f.l * 13 + greatest(-x, 0)) / 14 FROM f JOIN d ON d.symbol = f.symbol AND d.rn = f.rn + 1)"""


def _rsi_sql() -> str:
    from ..sources.logical import SQL

    return f"WITH RECURSIVE bars AS ({SQL['bars']}), {_SEED}\nSELECT symbol, date, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 5) AS rsi FROM f JOIN d USING (symbol, rn)"


@query("feat_rsi_seeded", _rsi_sql())
def feat_rsi_seeded(spark, sf_dir) -> DataFrame:
    """RSI whose first averages are plain means of fourteen moves."""

    def run(pdf):
        pdf = pdf.sort_values("date")
        x = pdf["close"].diff().to_numpy()[1:]
        up, down = x.clip(min=0), (-x).clip(min=0)
        if len(x) < 14:
            return pdf.iloc[:0].assign(rsi=0.0)[["symbol", "date", "rsi"]]
        g, loss = (smooth(np.r_[side[:14].mean(), side[14:]], 1 / 14) for side in (up, down))
        rsi = np.where(loss == 0, 100.0, 100 - 100 / (1 + g / np.where(loss == 0, 1.0, loss)))
        return pdf.iloc[14:].assign(rsi=rsi)[["symbol", "date", "rsi"]]

    b = bars(spark, sf_dir).select("symbol", "date", "close").groupBy("symbol").applyInPandas(run, "symbol string, date date, rsi double")
    return b.withColumn("rsi", F.round("rsi", 5))


@query("basket_vol", twin(f"SELECT round(stddev_samp(m), 6) AS vol, count(*)::BIGINT AS n FROM (SELECT m FROM (SELECT date, avg(r) AS m FROM (SELECT date, {_RET} AS r FROM bars) GROUP BY date) WHERE m IS NOT NULL ORDER BY date DESC LIMIT 20) HAVING count(*) >= 10"))
def basket_vol(spark, sf_dir) -> DataFrame:
    m = bars(spark, sf_dir).select("date", w.log_return(F.col("close")).alias("r")).groupBy("date").agg(F.avg("r").alias("m")).where("m is not null")
    return m.orderBy(F.desc("date")).limit(20).agg(r6(F.stddev_samp("m")).alias("vol"), F.count(F.lit(1)).alias("n")).where("n >= 10")


@query("macro_block", twin(f"""SELECT date, round(ln(x / lag(x) OVER (ORDER BY date)), 6) AS r1, round(ln(x / lag(x, 5) OVER (ORDER BY date)), 6) AS r5, round(coalesce((v - avg(v) OVER z) / nullif(CASE WHEN count(v) OVER z >= 60 THEN stddev_samp(v) OVER z END, 0), 0), 6) AS vz
    FROM (SELECT date, avg(close) AS x, avg(high - low) AS v FROM bars GROUP BY date) WINDOW z AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"""))
def macro_block(spark, sf_dir) -> DataFrame:
    """Market-wide level and range; one row per date."""
    m = bars(spark, sf_dir).groupBy("date").agg(F.avg("close").alias("x"), F.avg(F.col("high") - F.col("low")).alias("v"))
    days = Window.orderBy("date")
    z = days.rowsBetween(-251, 0)
    sd = F.when(F.count("v").over(z) >= 60, F.stddev_samp("v").over(z))
    ret = lambda n: r6(F.log(safe_div(F.col("x"), F.lag("x", n).over(days))))
    return m.select("date", ret(1).alias("r1"), ret(5).alias("r5"), r6(F.coalesce(safe_div(F.col("v") - F.avg("v").over(z), sd), F.lit(0.0))).alias("vz"))


@query("cross_symbol_summary", twin(f"SELECT count(*)::BIGINT AS symbols, round(avg(m), 6) AS mean_return, round(median(m), 6) AS median_return, round(avg(h), 6) AS mean_win FROM (SELECT symbol, avg(r) AS m, avg((r > 0)::INT) AS h FROM (SELECT symbol, {_RET} AS r FROM bars) WHERE r IS NOT NULL GROUP BY symbol HAVING count(*) >= 5)"))
def cross_symbol_summary(spark, sf_dir) -> DataFrame:
    s = bars(spark, sf_dir).select("symbol", w.log_return(F.col("close")).alias("r")).where("r is not null").groupBy("symbol").agg(F.avg("r").alias("m"), F.avg((F.col("r") > 0).cast("int")).alias("h"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    return s.agg(F.count(F.lit(1)).alias("symbols"), r6(F.avg("m")).alias("mean_return"), r6(F.percentile("m", 0.5)).alias("median_return"), r6(F.avg("h")).alias("mean_win"))


def _auc_sql(score: str) -> str:
    return f"(SELECT sum(pos * (below + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)) FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {score} AS s, sum(correct) AS pos, sum(1 - correct) AS neg FROM res GROUP BY 1)))"


_LIFTS = {"meta": "(prob_up + meta_prob) / 2", "confidence": "(prob_up + confidence / 100::DOUBLE) / 2", "act": "(prob_up + act) / 2"}


@query("auc_lift", twin(" UNION ALL ".join(f"SELECT '{n}' AS added, round({_auc_sql(e)} - {_auc_sql('prob_up')}, 6) AS lift" for n, e in _LIFTS.items()), _RES))
def auc_lift(spark, sf_dir) -> DataFrame:
    """What each further column adds to the ranking of the base score, on the same rows."""
    r = resolved(spark, sf_dir)
    base = auc(r, "correct", "prob_up").select(F.col("auc").alias("base"))
    added = {"meta": F.col("meta_prob"), "confidence": F.col("confidence") / 100, "act": F.col("act")}
    out = None
    for name, c in added.items():
        one = auc(r.withColumn("s", (F.col("prob_up") + c) / 2), "correct", "s").crossJoin(F.broadcast(base)).select(F.lit(name).alias("added"), r6(F.col("auc") - F.col("base")).alias("lift"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query("conviction_topk", twin("SELECT id, symbol, round(abs(prob_up - 0.5::DOUBLE) * meta_prob, 6) AS conviction FROM predictions ORDER BY abs(prob_up - 0.5::DOUBLE) * meta_prob DESC, id LIMIT 10"))
def conviction_topk(spark, sf_dir) -> DataFrame:
    c = F.abs(F.col("prob_up") - 0.5) * F.coalesce("meta_prob", F.lit(0.0))
    return predictions(spark, sf_dir).orderBy(F.desc(c), "id").limit(10).select("id", "symbol", r6(c).alias("conviction"))


_DRIFT = f"""SELECT symbol, n, CASE WHEN n >= 200 THEN round(acc, 6) END AS accuracy, CASE WHEN n >= 200 THEN round(s / n, 6) END AS ece, n >= 200 AND (acc < 0.48::DOUBLE OR s / n > 0.1::DOUBLE) AS drift,
  n >= 200 AND (acc < 0.48::DOUBLE OR s / n > 0.1::DOUBLE) AND age >= 3 AS retrain FROM
  (SELECT symbol, count(*)::BIGINT AS n, avg(correct) AS acc, (SELECT max(generated_at::DATE) FROM res) - min(generated_at::DATE) AS age FROM res GROUP BY symbol) JOIN
  (SELECT symbol, sum(k * gap) AS s FROM (SELECT symbol, count(*) AS k, abs(avg(p) - avg(correct)) AS gap FROM (SELECT symbol, confidence / 100::DOUBLE AS p, correct FROM res) WHERE p < 1 GROUP BY symbol, {_BIN}) GROUP BY symbol) USING (symbol)"""


@query("drift_decision", twin(_DRIFT, _RES))
def drift_decision(spark, sf_dir) -> DataFrame:
    """Retrain a symbol's model if its accuracy or its calibration drifts on enough outcomes, and it is three days old (since its first forecast)."""
    r = resolved(spark, sf_dir).withColumn("stated", F.col("confidence") / 100)
    newest = r.agg(F.max(F.to_date("generated_at")).alias("newest"))
    age = r.groupBy("symbol").agg(F.min(F.to_date("generated_at")).alias("first")).crossJoin(F.broadcast(newest))  # one row
    age = age.select("symbol", F.datediff("newest", "first").alias("age"))
    d = drift(r, ["symbol"], "correct", "stated").join(age, "symbol")
    return d.select("symbol", "n", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("ece")).alias("ece"), "drift", (F.col("drift") & (F.col("age") >= 3)).alias("retrain"))


@query("forecast_bundle", twin("SELECT symbol, date, open * k AS open, high * k AS high, low * k AS low, close * k AS close FROM (SELECT *, (1 - (volume::BIGINT % 5) / 100::DOUBLE) AS k, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars) WHERE n <= 60"))
def forecast_bundle(spark, sf_dir) -> DataFrame:
    """The last sixty bars with all prices scaled by the adjustment factor of the close."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    b = bars(spark, sf_dir).withColumn("k", 1 - (F.col("volume").cast("long") % 5) / 100).withColumn("n", n).where("n <= 60")
    return b.select("symbol", "date", *[(F.col(c) * F.col("k")).alias(c) for c in ("open", "high", "low", "close")])


@query("order_checks", twin("SELECT id, symbol, price, CASE WHEN abs(price - last) > 0.01::DOUBLE * last THEN 'price moved' WHEN price * 10 > 400 THEN 'no headroom' ELSE 'ok' END AS verdict FROM ticks JOIN (SELECT symbol, max(price) AS last FROM ticks GROUP BY symbol) USING (symbol)"))
def order_checks(spark, sf_dir) -> DataFrame:
    """An order passes within one percent of the server's price and inside the available amount."""
    t = ticks(spark, sf_dir)
    t = t.join(t.groupBy("symbol").agg(F.max("price").alias("last")), "symbol")
    verdict = F.when(F.abs(F.col("price") - F.col("last")) > 0.01 * F.col("last"), "price moved").when(F.col("price") * 10 > 400, "no headroom").otherwise("ok")
    return t.select("id", "symbol", "price", verdict.alias("verdict"))


@query("bar_validity", twin("SELECT symbol, date, close, coalesce(CASE WHEN volume::BIGINT % 3 > 0 THEN close * 0.99::DOUBLE END, close) AS adj_close FROM bars WHERE close > 0 AND volume > 10"))
def bar_validity(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir).where("close > 0 and volume > 10 and not isnan(close)")
    return b.select("symbol", "date", "close", F.coalesce(F.when(F.col("volume").cast("long") % 3 > 0, F.col("close") * 0.99), F.col("close")).alias("adj_close"))


@query("news_validity", "SELECT doc_id AS url, substr(text, 1, 200) AS summary FROM documents WHERE length(trim(text)) > 0 AND text <> '[Removed]' AND doc_id IS NOT NULL")
def news_validity(spark, sf_dir) -> DataFrame:
    d = raw(spark, sf_dir, "documents").where((F.length(F.trim("text")) > 0) & (F.col("text") != "[Removed]") & F.col("doc_id").isNotNull())
    return d.select(F.col("doc_id").alias("url"), F.substring("text", 1, 200).alias("summary"))


@query("rebased_band", twin("SELECT id, round(lo * f, 6) AS lo, round(hi * f, 6) AS hi FROM (SELECT p.id, band_lo AS lo, band_hi AS hi, a.price / nullif(last_close, 0) AS f FROM predictions p JOIN (SELECT symbol, arg_max(price, (ts, id)) AS price FROM ticks GROUP BY symbol) a USING (symbol)) WHERE f IS NOT NULL"))
def rebased_band(spark, sf_dir) -> DataFrame:
    """Stored bands moved to the newest tick of their symbol."""
    a = ticks(spark, sf_dir).groupBy("symbol").agg(F.max_by("price", F.struct("ts", "id")).alias("price"))
    p = predictions(spark, sf_dir).join(a, "symbol").withColumn("f", safe_div(F.col("price"), F.col("last_close"))).where("f is not null")
    return p.select("id", r6(F.col("band_lo") * F.col("f")).alias("lo"), r6(F.col("band_hi") * F.col("f")).alias("hi"))


@query("ttl_cache", twin("SELECT symbol, price, ts >= (SELECT max(ts) FROM ticks) - INTERVAL 2 HOUR AS fresh FROM (SELECT symbol, arg_max(price, (ts, id)) AS price, max(ts) AS ts FROM ticks GROUP BY symbol)"))
def ttl_cache(spark, sf_dir) -> DataFrame:
    """The newest value of each key and whether it is still within its time to live."""
    t = ticks(spark, sf_dir)
    now = t.agg(F.max("ts").alias("now"))
    k = t.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "id")).alias("price"), F.max("ts").alias("ts"))
    return k.crossJoin(F.broadcast(now)).select("symbol", "price", (F.col("ts") >= F.col("now") - F.expr("interval 2 hours")).alias("fresh"))  # one row


_THROTTLE = """o AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts, id) AS rn FROM t_),
f AS (SELECT symbol, rn, ts, ts AS ran, true AS run FROM o WHERE rn = 1 UNION ALL SELECT o.symbol, o.rn, o.ts, CASE WHEN o.ts >= f.ran + INTERVAL 12 HOUR THEN o.ts ELSE f.ran END, o.ts >= f.ran + INTERVAL 12 HOUR FROM f JOIN o ON o.symbol = f.symbol AND o.rn = f.rn + 1)"""


@query("throttled_runs", "WITH RECURSIVE t_ AS (SELECT 'S' || (user_id % 20)::VARCHAR AS symbol, ts, event_id AS id FROM events),\n" + _THROTTLE + "\nSELECT symbol, count(*) FILTER (WHERE run)::BIGINT AS runs, count(*)::BIGINT AS triggers FROM f GROUP BY symbol")
def throttled_runs(spark, sf_dir) -> DataFrame:
    """Downstream job runs at least twelve hours apart, beside all triggers of a symbol."""
    t = ticks(spark, sf_dir).select("symbol", "ts")
    runs = runs_apart(t, "symbol", "ts", "12 hours").groupBy("symbol").agg(F.count(F.lit(1)).alias("runs"))
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("triggers")).join(runs, "symbol").select("symbol", "runs", "triggers")


@query("vector_upsert", "SELECT vec_id AS id, CASE WHEN label IN (0, 3) THEN 2 ELSE 1 END AS version, len(embedding)::INT AS dims, CASE WHEN label IN (0, 3) THEN -embedding[1] ELSE embedding[1] END::DOUBLE AS first, round(list_sum(embedding::DOUBLE[]) * CASE WHEN label IN (0, 3) THEN -1 ELSE 1 END, 6) + 0 AS total FROM embeddings")
def vector_upsert(spark, sf_dir) -> DataFrame:
    """A keyed collection of all vectors; a second batch replaces those of two labels by their opposites."""
    e = raw(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.lit(1).alias("version"), "embedding", "label")
    store = KeyedTable(spark, scratch(spark, "vectors"), ["id"], f"id bigint, version int, embedding {dict(e.dtypes)['embedding']}")
    store.upsert(v.drop("label"), [F.desc("version")])
    again = v.where(F.col("label").isin(0, 3)).select("id", F.lit(2).alias("version"), F.transform("embedding", lambda x: -x).alias("embedding"))
    store.upsert(again, [F.desc("version")])
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return store.read().select("id", "version", F.size("embedding").alias("dims"), F.col("embedding")[0].cast("double").alias("first"), (r6(total) + 0.0).alias("total"))


@query("next_ids", twin("SELECT symbol, (SELECT max(id) FROM ticks) + row_number() OVER (ORDER BY symbol) AS id FROM (SELECT DISTINCT symbol FROM ticks)"))
def next_ids(spark, sf_dir) -> DataFrame:
    """Ids for new rows follow the largest existing one; the new rows are one per symbol."""
    t = ticks(spark, sf_dir)
    top = t.agg(F.max("id").alias("top"))
    new = t.select("symbol").distinct().withColumn("n", F.row_number().over(Window.orderBy("symbol")))
    return new.crossJoin(F.broadcast(top)).select("symbol", (F.col("top") + F.col("n")).alias("id"))  # one row


@query("blended_model", twin("SELECT id, round(0.5::DOUBLE + 0.5::DOUBLE * (CASE regime WHEN 'trend' THEN 0.7::DOUBLE * prob_up + 0.3::DOUBLE * meta_prob WHEN 'chop' THEN 0.5::DOUBLE * prob_up + 0.5::DOUBLE * meta_prob ELSE 0.2::DOUBLE * prob_up + 0.8::DOUBLE * meta_prob END - 0.5::DOUBLE), 6) AS p FROM predictions"))
def blended_model(spark, sf_dir) -> DataFrame:
    """Mixture of two models weighted by regime and shrunk half way to one half."""
    wt = F.when(F.col("regime") == "trend", 0.7).when(F.col("regime") == "chop", 0.5).otherwise(0.2)
    anti = F.when(F.col("regime") == "trend", 0.3).when(F.col("regime") == "chop", 0.5).otherwise(0.8)
    return predictions(spark, sf_dir).select("id", r6(0.5 + 0.5 * (wt * F.col("prob_up") + anti * F.col("meta_prob") - 0.5)).alias("p"))


@query("warmup_modes", twin(f"SELECT symbol, date, round(x, 6) AS dropped, round(coalesce(x, first_value(x IGNORE NULLS) OVER {_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 6) AS filled FROM (SELECT symbol, date, close / CASE WHEN count(close) OVER s >= 20 THEN avg(close) OVER s END - 1 AS x FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"))
def warmup_modes(spark, sf_dir) -> DataFrame:
    """Warm-up rows left NULL (causal) beside the compatible mode that fills them from the future."""
    b = bars(spark, sf_dir).select("symbol", "date", (F.col("close") / w.rmean(F.col("close"), 20) - 1).alias("x"))
    return b.select("symbol", "date", r6(F.col("x")).alias("dropped"), r6(F.coalesce(F.col("x"), w.bfill(F.col("x")), F.lit(0.0))).alias("filled"))


@query("goal_progress", twin("SELECT user_id, round(sum(greatest(amount, 0)), 2) AS saved, least(100, round(100 * sum(greatest(amount, 0)) / 3000000))::INT AS pct, floor(sum(greatest(amount, 0)) / 1000)::BIGINT AS points FROM transactions GROUP BY user_id"))
def goal_progress(spark, sf_dir) -> DataFrame:
    saved = F.sum(F.greatest(F.col("amount"), F.lit(0.0)))
    g = transactions(spark, sf_dir).groupBy("user_id").agg(saved.alias("s"))
    return g.select("user_id", F.round("s", 2).alias("saved"), F.least(F.lit(100), F.round(100 * F.col("s") / 3000000)).cast("int").alias("pct"), F.floor(F.col("s") / 1000).alias("points"))


@query("display_confidence", twin("SELECT p.id, CASE WHEN v.label IS NULL OR v.label = 'agree' THEN p.confidence ELSE least(p.confidence, v.llm_confidence) END AS confidence FROM predictions p LEFT JOIN verdicts v ON v.id = p.id"))
def display_confidence(spark, sf_dir) -> DataFrame:
    v = verdicts(spark, sf_dir).select("id", "label", "llm_confidence")
    c = F.when(F.col("label").isNull() | (F.col("label") == "agree"), F.col("confidence")).otherwise(F.least("confidence", "llm_confidence"))
    return predictions(spark, sf_dir).join(v, "id", "left").select("id", c.alias("confidence"))
