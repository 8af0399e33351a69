"""Readers of the documented data files: one folder for each kind, many files, one row per symbol and UTC day out.

What does not parse is NULL; rows without a day are dropped.  A file's symbol stands in its name (``kind_SYMBOL.csv``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.asof import daily_spine

#: Columns of the on-chain file, and the chain-health files.
ONCHAIN = {"AdrActCnt": "adr_act", "TxCnt": "tx_cnt", "SplyCur": "sply_cur", "CapMrktCurUSD": "cap_mkt_usd", "PriceUSD": "price_cm"}
HEALTH = {"hash-rate.csv": "hashrate", "n-transactions.csv": "n_tx", "n-unique-addresses.csv": "n_unique_addr", "transaction-fees.csv": "tx_fees"}


def number(c: str) -> Column:
    return F.expr(f"try_cast(`{c}` as double)")


def day(c: str) -> Column:
    """Epoch milliseconds, or a date or time string in one of the usual forms, as a UTC day."""
    ms = F.expr(f"to_date(timestamp_millis(try_cast(`{c}` as bigint)))")
    text = F.expr(f"to_date(coalesce(try_to_timestamp(replace(`{c}`, 'Z', '')), try_to_timestamp(`{c}`, \"yyyyMMdd'T'HHmmss'Z'\"), try_to_timestamp(`{c}`, 'yyyyMMddHHmmss')))")
    return F.when(F.col(c).rlike("^-?[0-9]{9,13}$"), ms).otherwise(text)


def _files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    name = F.regexp_extract("_metadata.file_name", rf"^{kind}_(.+)\.csv$", 1)
    place = F.struct((-F.col("_metadata.file_block_start")).alias("block"), (-F.monotonically_increasing_id()).alias("row"))
    return spark.read.csv(f"{folder}/{kind}_*.csv", header=True).select("*", F.upper(name).alias("symbol"), place.alias("_place"))


def _last(c: str) -> Column:
    """``c`` of the row with the largest ``t`` that has one; of several at that time the first in the file."""
    return F.max_by(c, F.when(F.col(c).isNotNull() & F.col("t").isNotNull(), F.struct("t", "_place")))


def funding(spark: SparkSession, folder: str) -> DataFrame:
    """Funding of a day: the sum of its rates, and the last of them (of several at one time the first in the file)."""
    rows = _files(spark, folder, "funding").select("symbol", "_place", day("calc_time").alias("date"), number("calc_time").alias("t"), number("last_funding_rate").alias("rate"))
    return rows.where("date is not null and rate is not null").groupBy("symbol", "date").agg(F.sum("rate").alias("funding"), _last("rate").alias("funding_last"))


def open_interest(spark: SparkSession, folder: str) -> DataFrame:
    """Last open interest and its value, mean ratios, of the five-minute rows of a day."""
    names = {"sum_open_interest": "oi", "sum_open_interest_value": "oi_value", "sum_taker_long_short_vol_ratio": "ls_ratio", "sum_toptrader_long_short_ratio": "top_ls"}
    rows = _files(spark, folder, "oi").select("symbol", "_place", day("create_time").alias("date"), F.col("create_time").alias("t"), *[number(c).alias(n) for c, n in names.items()])
    return rows.where("date is not null").groupBy("symbol", "date").agg(_last("oi").alias("oi"), _last("oi_value").alias("oi_value"), F.avg("ls_ratio").alias("ls_ratio"), F.avg("top_ls").alias("top_ls"))


def implied_vol(spark: SparkSession, folder: str) -> DataFrame:
    """Close and open of the volatility index; rows without a close are dropped."""
    rows = _files(spark, folder, "dvol").select("symbol", day("date").alias("date"), number("close").alias("dvol"), number("open").alias("dvol_open"))
    return rows.where("date is not null and dvol is not null")


def onchain(spark: SparkSession, path: str, symbols: list[str]) -> DataFrame:
    """The long file (asset, time, metrics) for the symbols, under our names; rows without addresses and transactions are no activity and go."""
    rows = spark.read.csv(path, header=True).select(F.upper("asset").alias("symbol"), day("time").alias("date"), *[number(c).alias(n) for c, n in ONCHAIN.items()])
    idle = (F.coalesce("adr_act", F.lit(0.0)) == 0) & (F.coalesce("tx_cnt", F.lit(0.0)) == 0)
    return rows.where(F.col("symbol").isin(symbols) & F.col("date").isNotNull() & ~idle)


def chain_health(spark: SparkSession, folder: str, symbol: str = "BTC") -> DataFrame:
    """The headerless files (time, value) side by side on every day from the first to the last, each carried forward."""
    parts = []
    for name, column in HEALTH.items():
        rows = spark.read.csv(f"{folder}/{name}", schema="t string, v string").select(day("t").alias("date"), number("v").alias(column), F.col("t").alias("_t"))
        parts.append(rows.where("date is not null").groupBy("date").agg(F.max_by(column, "_t").alias(column)))
    wide = reduce(lambda a, b: a.join(b, "date", "full"), parts).withColumn("symbol", F.lit(symbol))
    spine = daily_spine(wide, ["symbol"], "date").join(wide, ["symbol", "date"], "left")
    carried = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return spine.select("symbol", "date", *[F.last(c, ignorenulls=True).over(carried).alias(c) for c in HEALTH.values()])


def fear_greed(spark: SparkSession, path: str) -> DataFrame:
    """``data[]`` of one document: epoch seconds, value, class (all as text)."""
    docs = spark.read.json(path, schema="data array<struct<timestamp: string, value: string, value_classification: string>>", multiLine=True)
    rows = docs.select(F.explode("data").alias("r")).select(F.expr("to_date(timestamp_seconds(try_cast(r.timestamp as bigint)))").alias("date"), F.expr("try_cast(r.value as double)").alias("fng"), F.col("r.value_classification").alias("fng_class"))
    return rows.where("date is not null")


def tone(spark: SparkSession, path: str) -> DataFrame:
    """``timeline[0].data[]`` of the documents of a folder: date (in either form), tone, volume; the file's name is the symbol."""
    docs = spark.read.json(path, schema="timeline array<struct<data: array<struct<date: string, value: double, norm: double>>>>", multiLine=True)
    rows = docs.select(F.upper(F.regexp_extract("_metadata.file_name", r"^(.+)\.json$", 1)).alias("symbol"), F.explode(F.expr("timeline[0].data")).alias("r"))
    rows = rows.select("symbol", F.col("r.date").alias("t"), F.col("r.value").alias("tone"), F.col("r.norm").alias("vol"))
    return rows.select("symbol", day("t").alias("date"), "tone", "vol").where("date is not null")


def news_sentiment(spark: SparkSession, path: str) -> DataFrame:
    """A feed's articles by ticker and day: relevance-weighted sentiment (the plain mean where nothing is relevant), mean relevance, count."""
    schema = "time_published string, ticker_sentiment array<struct<ticker: string, relevance_score: string, ticker_sentiment_score: string>>"
    docs = spark.read.json(path, schema=f"feed array<struct<{schema}>>")
    rows = docs.select(F.explode("feed").alias("a")).select(F.expr("to_date(try_to_timestamp(replace(a.time_published, 'T', ''), 'yyyyMMddHHmmss'))").alias("date"), F.explode("a.ticker_sentiment").alias("s"))
    rows = rows.select(F.upper("s.ticker").alias("symbol"), "date", F.expr("try_cast(coalesce(s.relevance_score, '0') as double)").alias("rel"), F.expr("try_cast(coalesce(s.ticker_sentiment_score, '0') as double)").alias("sc"))
    sums = rows.where("date is not null and rel is not null and sc is not null").groupBy("symbol", "date")
    weighted = F.try_divide(F.sum(F.col("rel") * F.col("sc")), F.nullif(F.sum("rel"), F.lit(0.0)))
    return sums.agg(F.coalesce(weighted, F.avg("sc")).alias("av_sent"), F.avg("rel").alias("av_relevance"), F.count(F.lit(1)).alias("av_n"))
