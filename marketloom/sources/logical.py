"""The driver's tables as market and ledger tables; the only place that knows their names.

Every table exists twice: as a DataFrame, and in ``SQL`` as the query that defines the same rows, from which the
twins of the registered queries are put together.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars: symbol, date, open, high, low, close, volume."""
    lines = raw(spark, sf_dir, "lineitem").select(*_KEY, (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"))
    part = raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    at = F.struct(*_KEY)
    return lines.join(part, "l_partkey").groupBy("symbol", "date").agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("l_quantity").alias("volume"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, symbol, ts, price, event_type."""
    return raw(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("symbol"), "ts", F.col("value").alias("price"), "event_type", "user_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = raw(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        i.alias("id"), F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("symbol"), F.col("ts").alias("generated_at"), ((i * 37) % 100 / 100).alias("prob_up"), ((i * 29) % 100 / 100).alias("meta_prob"),
        (i % 3 == 0).cast("int").alias("act"), ((i * 53) % 100).cast("int").alias("confidence"), F.element_at(F.array(F.lit("trend"), F.lit("chop"), F.lit("risk_off")), (i % 3 + 1).cast("int")).alias("regime"),
        F.date_add(F.to_date("ts"), 5).alias("target_date"), F.col("value").alias("last_close"), (F.col("value") * 0.9).alias("band_lo"), (F.col("value") * 1.2).alias("band_hi"), (i % 6).cast("int").alias("fold"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return raw(spark, sf_dir, "events").where(i % 3 != 0).select(i.alias("prediction_id"), (((i * 41) % 200 - 100) / 1000).alias("actual_return"), ((i * 17) % 10 < 5).cast("int").alias("correct"), F.when(i % 5 != 0, (i % 2).cast("int")).alias("in_band"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return raw(spark, sf_dir, "events").where(i % 4 == 0).select(
        i.alias("id"), F.concat(F.lit("S"), (F.col("user_id") % 20).cast("string")).alias("symbol"), F.date_trunc("hour", "ts").alias("generated_at"), F.when(i % 8 == 0, "verdict").otherwise("insight").alias("insight_type"),
        F.element_at(F.array(F.lit("agree"), F.lit("downgrade"), F.lit("veto")), (i / 4 % 3 + 1).cast("int")).alias("label"), ((i * 31) % 100).cast("int").alias("llm_confidence"), F.element_at(F.array(F.lit("bullish"), F.lit("bearish"), F.lit("neutral")), (i / 4 % 3 + 1).cast("int")).alias("sentiment"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = raw(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("tx_date"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice")).alias("amount"), F.lower(F.substring("o_orderpriority", 3, 30)).alias("category"), F.concat(F.lit("A"), (F.col("o_custkey") % 3).cast("string")).alias("account"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, symbol, side, quantity, price, trade_date, seq (a total order of a user's trades in a symbol)."""
    lines = raw(spark, sf_dir, "lineitem").select(*_KEY, "l_returnflag")
    orders = raw(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    part = raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return lines.join(orders, "l_orderkey").join(part, "l_partkey").select("user_id", "symbol", F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.to_date("l_shipdate").alias("trade_date"), F.struct(*_KEY).alias("seq"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, symbol, lang, n_chars, title (for display), text, score, published."""
    d, lab = raw(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.substring("text", 1, 40).alias("title"), "text"), raw(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(F.col("doc_id").alias("url"), F.col("source").alias("symbol"), "lang", "n_chars", "title", "text", F.when(F.col("toxic") == 1, -1.0).when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.0).alias("score"), F.date_sub(F.lit("2024-02-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("published"))


#: Definitions for the SQL twins.
SQL: dict[str, str] = {
    "bars": f"""SELECT symbol, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(l_quantity) AS volume FROM (
        SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price, l_quantity, row({', '.join(_KEY)}) AS k FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY symbol, date""",
    "ticks": "SELECT event_id AS id, 'S' || (user_id % 20)::VARCHAR AS symbol, ts, value AS price, event_type, user_id FROM events",
    "predictions": """SELECT event_id AS id, 'S' || (user_id % 20)::VARCHAR AS symbol, ts AS generated_at, (event_id * 37) % 100 / 100::DOUBLE AS prob_up, (event_id * 29) % 100 / 100::DOUBLE AS meta_prob, (event_id % 3 = 0)::INT AS act,
        ((event_id * 53) % 100)::INT AS confidence, ['trend', 'chop', 'risk_off'][event_id % 3 + 1] AS regime, (ts::DATE + 5)::DATE AS target_date, value AS last_close, value * 0.9::DOUBLE AS band_lo, value * 1.2::DOUBLE AS band_hi, (event_id % 6)::INT AS fold FROM events""",
    "outcomes": "SELECT event_id AS prediction_id, ((event_id * 41) % 200 - 100) / 1000::DOUBLE AS actual_return, ((event_id * 17) % 10 < 5)::INT AS correct, CASE WHEN event_id % 5 <> 0 THEN (event_id % 2)::INT END AS in_band FROM events WHERE event_id % 3 <> 0",
    "verdicts": """SELECT event_id AS id, 'S' || (user_id % 20)::VARCHAR AS symbol, date_trunc('hour', ts) AS generated_at, CASE WHEN event_id % 8 = 0 THEN 'verdict' ELSE 'insight' END AS insight_type,
        ['agree', 'downgrade', 'veto'][event_id // 4 % 3 + 1] AS label, ((event_id * 31) % 100)::INT AS llm_confidence, ['bullish', 'bearish', 'neutral'][event_id // 4 % 3 + 1] AS sentiment FROM events WHERE event_id % 4 = 0""",
    "transactions": """SELECT o_orderkey AS id, o_custkey AS user_id, o_orderdate::DATE AS tx_date, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END AS amount, lower(substr(o_orderpriority, 3)) AS category,
        'A' || (o_custkey % 3)::VARCHAR AS account, 'Order ' || o_orderkey::VARCHAR AS title FROM orders""",
    "trades": f"""SELECT o_custkey AS user_id, p_brand AS symbol, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_shipdate::DATE AS trade_date, row({', '.join(_KEY)}) AS seq
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "news": """SELECT d.doc_id AS url, source AS symbol, lang, n_chars, substr(text, 1, 40) AS title, text, CASE WHEN toxic = 1 THEN -1::DOUBLE WHEN quality = 1 THEN 1::DOUBLE WHEN quality = 0 THEN 0::DOUBLE END AS score,
        (DATE '2024-02-01' - (d.doc_id % 30)::INT)::DATE AS published FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}


def twin(body: str, *extra: tuple[str, str], recursive: bool = False) -> str:
    """Prefix ``body`` with the definitions of the logical tables it names, then with ``extra`` named queries."""
    text = body + " ".join(q for _, q in extra)
    parts = [(n, q) for n, q in SQL.items() if re.search(rf"\b{n}\b", text)] + list(extra)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(f"{n} AS ({q})" for n, q in parts) + "\n" if parts else "") + body
