"""The daily cycle: resolve what is due, take the newest predictions, build the book, let it be reviewed, plan the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import keep_last
from ..operators.book import planned_orders, target_book, with_verdicts
from ..operators.chain import Chain, Step
from ..operators.windows import log_return
from ..registry import query
from ..sources.files import scratch
from ..sources.logical import predictions, ticks, twin, verdicts
from .portfolios import resolve_outcomes


def newest_predictions(spark, sf_dir) -> DataFrame:
    """The last prediction of each symbol, with the regime of the last one of all."""
    p = predictions(spark, sf_dir)
    regime = p.agg(F.max_by("regime", F.struct("generated_at", "id")).alias("regime"))
    return keep_last(p, ["symbol"], [F.desc("generated_at"), F.desc("id")]).select("symbol", "prob_up", "confidence").crossJoin(F.broadcast(regime))  # one row


def daily_returns(spark, sf_dir) -> DataFrame:
    closes = ticks(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("date")).agg(F.max_by("price", F.struct("ts", "id")).alias("close"))
    return closes.select("symbol", "date", log_return(F.col("close")).alias("ret"))


def reviews(spark, sf_dir) -> DataFrame:
    v = verdicts(spark, sf_dir).where("insight_type = 'verdict'").groupBy("symbol").agg(F.max_by(F.struct("label", "llm_confidence"), F.struct("generated_at", "id")).alias("v"))
    return v.select("symbol", (F.col("v.label") == "veto").alias("veto"), F.when(F.col("v.label") == "downgrade", F.col("v.llm_confidence")).alias("final_confidence"))


_CYCLE = (
    ("la", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY generated_at DESC, id DESC) AS r FROM predictions) WHERE r = 1"),
    ("hd", "SELECT *, 1 / count(*) OVER ()::DOUBLE AS w FROM (SELECT symbol, prob_up - 0.5::DOUBLE AS edge, confidence, row_number() OVER (ORDER BY prob_up DESC, symbol) AS n FROM la WHERE prob_up > 0.5) WHERE n <= greatest(1, round_even(0.1::DOUBLE * (SELECT count(*) FROM la), 0))"),
    ("cl", "SELECT symbol, date, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS r FROM (SELECT symbol, ts::DATE AS date, arg_max(price, (ts, id)) AS close FROM ticks GROUP BY ALL)"),
    ("bs", "SELECT date, avg(r) AS m FROM cl WHERE r IS NOT NULL AND symbol IN (SELECT symbol FROM hd) GROUP BY date"),
    ("lv", """SELECT CASE WHEN (SELECT count(*) FROM bs) >= 10 AND sd > 0 THEN least(3, greatest(0, 0.3::DOUBLE / sqrt(252) / sd)) ELSE 1 END AS lev,
      (SELECT CASE arg_max(regime, (generated_at, id)) WHEN 'chop' THEN 0.6::DOUBLE WHEN 'risk_off' THEN 0.25::DOUBLE ELSE 1 END FROM predictions) AS gross FROM (SELECT stddev_samp(m) AS sd FROM (SELECT m FROM bs ORDER BY date DESC LIMIT 20))"""),
    ("tb", "SELECT symbol, round(edge, 4) AS edge, confidence, round(w, 4) AS weight, round(gross * lev * w, 4) AS target_frac, round(100000 * gross * lev * w, 2) AS notional FROM hd CROSS JOIN lv"),
    ("vd", "SELECT symbol, arg_max(label, (generated_at, id)) AS label, arg_max(llm_confidence, (generated_at, id)) AS c FROM verdicts WHERE insight_type = 'verdict' GROUP BY symbol"),
    ("vf", """SELECT symbol, confidence, CASE WHEN k IS NOT NULL THEN round(target_frac * k, 4) ELSE target_frac END AS target_frac, CASE WHEN k IS NOT NULL THEN round(notional * k, 2) ELSE notional END AS notional FROM (
      SELECT tb.*, CASE WHEN label = 'downgrade' AND confidence > 0 AND c < confidence THEN c / confidence::DOUBLE END AS k FROM tb LEFT JOIN vd ON vd.symbol = tb.symbol WHERE label IS NULL OR label <> 'veto')"""),
    ("od", "SELECT * FROM (SELECT symbol, round(least(10000, 100000 * target_frac), 2) AS notional FROM vf WHERE target_frac > 0) WHERE notional >= 1"),
)


@query("target_book", twin("SELECT * FROM tb", *_CYCLE[:6]))
def book_of_the_day(spark, sf_dir) -> DataFrame:
    """Names, weights and notionals under the regime gate and the volatility lever."""
    return target_book(newest_predictions(spark, sf_dir), daily_returns(spark, sf_dir))


def cycle_steps(spark: SparkSession, sf_dir: str) -> list[Step]:
    return [
        Step("resolve", lambda d: resolve_outcomes(spark, sf_dir)),
        Step("predict", lambda d: newest_predictions(spark, sf_dir)),
        Step("book", lambda d: target_book(d["predict"], daily_returns(spark, sf_dir))),
        Step("verify", lambda d: with_verdicts(d["book"], reviews(spark, sf_dir)), otherwise=lambda d: d["book"]),  # no review, no change
        Step("paper", lambda d: planned_orders(d["verify"])),
    ]


_TOTALS = {"resolve": "pnl", "predict": "prob_up", "book": "target_frac", "verify": "target_frac", "paper": "notional"}


@query("daily_cycle", twin("""SELECT 'resolve' AS step, count(*) AS n, round(sum(round(CASE WHEN act = 1 THEN CASE WHEN prob_up >= 0.5 THEN ret ELSE -ret END - 0.0005::DOUBLE ELSE 0 END, 6)), 3) AS total FROM (
      SELECT p.*, m.px / nullif(last_close, 0) - 1 AS ret FROM predictions p ASOF JOIN (SELECT symbol, ts::DATE AS date, arg_max(price, (ts, id)) AS px FROM ticks GROUP BY ALL) m ON p.symbol = m.symbol AND p.target_date <= m.date)
    UNION ALL SELECT 'predict', count(*), round(sum(prob_up), 3) FROM la UNION ALL SELECT 'book', count(*), coalesce(round(sum(target_frac), 3), 0) FROM tb
    UNION ALL SELECT 'verify', count(*), coalesce(round(sum(target_frac), 3), 0) FROM vf UNION ALL SELECT 'paper', count(*), coalesce(round(sum(notional), 3), 0) FROM od""", *_CYCLE))
def daily_cycle(spark, sf_dir) -> DataFrame:
    """What every step of one restartable day has made: rows, and the sum of its main figure."""
    done = Chain(spark, scratch(spark, "day")).run(cycle_steps(spark, sf_dir))
    out = None
    for step, figure in _TOTALS.items():
        row = done[step].agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.sum(figure), 3), F.lit(0.0)).alias("total"))
        out = row if out is None else out.unionByName(row)
    return out
