"""The documented data files: each query writes such files from the tables, and reads them with the feed's reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import r6
from ..registry import query
from ..sources import feeds
from ..sources.files import scratch
from ..sources.logical import ticks, twin

_MS = "(epoch_ms(date_trunc('second', ts)))"


def _by_symbol(df: DataFrame, folder: str, kind: str, order: str | None = None) -> None:
    """CSV files ``kind_SYMBOL.csv`` with a header, rows in order of the column ``order``, which is not written; Spark's writer names files itself, so they are renamed."""
    spark = df.sparkSession
    rows = df.repartition(20, "symbol")
    rows = rows.sortWithinPartitions("symbol", order).drop(order) if order else rows
    rows.write.partitionBy("symbol").csv(f"{folder}/raw", header=True)
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(f"{folder}/raw")
    store = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for part in store.listStatus(root):  # a folder for each of the twenty symbols, one file in it
        name = part.getPath().getName()
        if "=" in name:
            file = next(f.getPath() for f in store.listStatus(part.getPath()) if f.getPath().getName().startswith("part-"))
            store.rename(file, path(f"{folder}/{kind}_{name.split('=')[1]}.csv"))


@query("feed_funding", twin(f"SELECT symbol, ts::DATE AS date, round(sum(price) / 1000, 6) AS funding, round(arg_max(price, {_MS}) / 1000, 6) AS funding_last FROM ticks WHERE id % 11 <> 0 GROUP BY ALL"))
def feed_funding(spark, sf_dir) -> DataFrame:
    """Funding files with epoch milliseconds; some rates are no numbers."""
    folder = scratch(spark, "funding")
    rate = F.when(F.col("id") % 11 == 0, "n/a").otherwise((F.col("price") / 1000).cast("string"))
    ms = F.unix_seconds(F.col("ts").cast("timestamp")) * 1000
    _by_symbol(ticks(spark, sf_dir).select("id", "symbol", ms.alias("calc_time"), F.lit(8).alias("funding_interval_hours"), rate.alias("last_funding_rate")), folder, "funding", "id")
    f = feeds.funding(spark, folder)
    return f.select("symbol", "date", r6(F.col("funding")).alias("funding"), r6(F.col("funding_last")).alias("funding_last"))


@query("feed_open_interest", twin("""SELECT symbol, ts::DATE AS date, arg_max(price, ts) FILTER (WHERE id % 7 <> 0) AS oi, arg_max(price * 2, ts) AS oi_value, round(avg(price / 10) FILTER (WHERE id % 5 <> 0), 9) AS ls_ratio, round(avg(id % 13), 9) AS top_ls FROM ticks GROUP BY ALL"""))
def feed_open_interest(spark, sf_dir) -> DataFrame:
    folder, i = scratch(spark, "oi"), F.col("id")
    _by_symbol(
        ticks(spark, sf_dir).select(
            "id", "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("create_time"), F.when(i % 7 != 0, F.col("price")).alias("sum_open_interest"), (F.col("price") * 2).alias("sum_open_interest_value"),
            F.when(i % 5 != 0, (F.col("price") / 10).cast("string")).otherwise("-").alias("sum_taker_long_short_vol_ratio"), (i % 13).alias("sum_toptrader_long_short_ratio"),
        ), folder, "oi", "id",
    )
    f = feeds.open_interest(spark, folder)
    return f.select("symbol", "date", "oi", "oi_value", F.round("ls_ratio", 9).alias("ls_ratio"), F.round("top_ls", 9).alias("top_ls"))


@query("feed_implied_vol", twin("SELECT symbol, date, dvol, dvol_open FROM (SELECT symbol, ts::DATE AS date, max(price) AS dvol, min(price) AS dvol_open, count(*) AS n FROM ticks GROUP BY ALL) WHERE n % 4 <> 0"))
def feed_implied_vol(spark, sf_dir) -> DataFrame:
    folder = scratch(spark, "dvol")
    d = ticks(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("d")).agg(F.max("price").alias("close"), F.min("price").alias("open"), F.count(F.lit(1)).alias("n"))
    close = F.when(F.col("n") % 4 != 0, F.col("close").cast("string")).otherwise("")
    _by_symbol(d.select("symbol", F.concat(F.col("d").cast("string"), F.lit("T00:00:00Z")).alias("date"), "open", close.alias("close")), folder, "dvol")
    return feeds.implied_vol(spark, folder)


@query("feed_onchain", twin("""SELECT symbol, date, adr_act, tx_cnt, sply_cur, cap_mkt_usd, NULL::DOUBLE AS price_cm FROM (
    SELECT symbol, date, CASE WHEN extract(day FROM date) % 5 = 0 THEN 0 WHEN extract(day FROM date) % 5 <> 1 THEN n END::DOUBLE AS adr_act, CASE WHEN extract(day FROM date) % 3 <> 0 THEN last END::DOUBLE AS tx_cnt, sply_cur, cap_mkt_usd FROM (
      SELECT symbol, ts::DATE AS date, count(*) AS n, max(id) AS last, min(price) AS sply_cur, max(price) AS cap_mkt_usd FROM ticks WHERE symbol IN ('S1', 'S2', 'S3') GROUP BY ALL))
    WHERE coalesce(adr_act, 0) <> 0 OR coalesce(tx_cnt, 0) <> 0"""))
def feed_onchain(spark, sf_dir) -> DataFrame:
    """Days without addresses or transactions, or without both, are in the file; the last are dropped."""
    path = f"{scratch(spark, 'onchain')}/onchain.csv"
    of = F.dayofmonth(F.first(F.to_date("ts")))
    addresses, moves = F.when(of % 5 == 0, 0).when(of % 5 != 1, F.count(F.lit(1))), F.when(of % 3 != 0, F.max("id"))
    d = ticks(spark, sf_dir).groupBy(F.lower("symbol").alias("asset"), F.to_date("ts").cast("string").alias("time")).agg(addresses.alias("AdrActCnt"), moves.alias("TxCnt"), F.min("price").alias("SplyCur"), F.max("price").alias("CapMrktCurUSD"), F.lit("missing").alias("PriceUSD"))
    d.write.csv(path, header=True)
    return feeds.onchain(spark, path, ["S1", "S2", "S3"])


@query("feed_chain_health", twin("""SELECT 'BTC' AS symbol, date, last_value(h IGNORE NULLS) OVER w AS hashrate, last_value(n IGNORE NULLS) OVER w AS n_tx, last_value(u IGNORE NULLS) OVER w AS n_unique_addr, last_value(f IGNORE NULLS) OVER w AS tx_fees FROM
    (SELECT unnest(generate_series(min(ts::DATE), max(ts::DATE), INTERVAL 1 DAY))::DATE AS date FROM ticks WHERE extract(day FROM ts) % 3 = 0 OR extract(day FROM ts) % 4 = 0 OR extract(day FROM ts) % 5 = 0 OR extract(day FROM ts) % 7 = 0)
    LEFT JOIN (SELECT ts::DATE AS date, CASE WHEN extract(day FROM ts::DATE) % 3 = 0 THEN max(price) END AS h, CASE WHEN extract(day FROM ts::DATE) % 4 = 0 THEN count(*)::DOUBLE END AS n, CASE WHEN extract(day FROM ts::DATE) % 5 = 0 THEN min(price) END AS u, CASE WHEN extract(day FROM ts::DATE) % 7 = 0 THEN max(id)::DOUBLE END AS f FROM ticks GROUP BY 1) USING (date) WINDOW w AS (ORDER BY date)"""))
def feed_chain_health(spark, sf_dir) -> DataFrame:
    """Four files with other days each."""
    folder = scratch(spark, "health")
    d = ticks(spark, sf_dir).groupBy(F.to_date("ts").alias("d")).agg(F.max("price").alias("h"), F.count(F.lit(1)).alias("n"), F.min("price").alias("u"), F.max("id").alias("f"))
    for name, column, step in zip(feeds.HEALTH, "hnuf", (3, 4, 5, 7)):
        d.where(F.dayofmonth("d") % step == 0).select(F.concat(F.col("d").cast("string"), F.lit(" 00:00:00")), column).coalesce(1).write.csv(f"{folder}/{name}")
    return feeds.chain_health(spark, folder)


@query("feed_fear_greed", twin("SELECT ts::DATE AS date, (count(*) % 100)::DOUBLE AS fng, min(event_type) AS fng_class FROM ticks GROUP BY ALL"))
def feed_fear_greed(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "fng")
    d = ticks(spark, sf_dir).groupBy(F.to_date("ts").alias("d")).agg((F.count(F.lit(1)) % 100).cast("string").alias("value"), F.min("event_type").alias("value_classification"))
    d = d.select(F.struct(F.unix_seconds(F.col("d").cast("timestamp")).cast("string").alias("timestamp"), "value", "value_classification").alias("p"))
    d.agg(F.collect_list("p").alias("data")).write.json(path)  # one document holds the index of all days, one point a day
    return feeds.fear_greed(spark, path)


@query("feed_tone", twin("SELECT symbol, ts::DATE AS date, max(price) AS tone, count(*)::DOUBLE AS vol FROM ticks GROUP BY ALL"))
def feed_tone(spark, sf_dir) -> DataFrame:
    """Timelines with dates in either of the two forms; points without a date are dropped."""
    folder = scratch(spark, "tone")
    d = ticks(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("d")).agg(F.max("price").alias("value"), F.count(F.lit(1)).cast("double").alias("norm"))
    form = F.when(F.dayofmonth("d") % 2 == 0, F.date_format("d", "yyyyMMdd'T'HHmmss'Z'")).otherwise(F.concat(F.col("d").cast("string"), F.lit("T00:00:00Z")))
    points = d.select("symbol", F.struct(form.alias("date"), "value", "norm").alias("p")).groupBy("symbol").agg(F.collect_list("p").alias("data"))  # a point a day
    docs = points.select("symbol", F.array(F.struct(F.concat("data", F.array(F.struct(F.lit("soon").alias("date"), F.lit(0.0).alias("value"), F.lit(0.0).alias("norm")))).alias("data"))).alias("timeline"))
    docs.repartition(20, "symbol").write.partitionBy("symbol").json(f"{folder}/raw")
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for part in store.listStatus(path(f"{folder}/raw")):
        name = part.getPath().getName()
        if "=" in name:
            file = next(f.getPath() for f in store.listStatus(part.getPath()) if f.getPath().getName().startswith("part-"))
            store.rename(file, path(f"{folder}/{name.split('=')[1]}.json"))
    return feeds.tone(spark, f"{folder}/*.json")


@query("feed_news", twin("""SELECT symbol, date, round(coalesce(sum(rel * sc) / nullif(sum(rel), 0), avg(sc)), 9) AS av_sent, round(avg(rel), 9) AS av_relevance, count(*)::BIGINT AS av_n FROM
    (SELECT symbol, ts::DATE AS date, (id % 3) / 2::DOUBLE AS rel, price / 100 - 0.5::DOUBLE AS sc FROM ticks WHERE id % 10 <> 0 UNION ALL SELECT 'MARKET', ts::DATE, 0.1::DOUBLE, 0.2::DOUBLE FROM ticks WHERE id % 10 <> 0) GROUP BY ALL"""))
def feed_news(spark, sf_dir) -> DataFrame:
    """Articles with several tickers each; a tenth has no time."""
    path = scratch(spark, "news")
    i = F.col("id")
    mention = lambda ticker, rel, sc: F.struct(ticker.alias("ticker"), rel.cast("string").alias("relevance_score"), sc.cast("string").alias("ticker_sentiment_score"))
    when = F.when(i % 10 == 0, "").otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss"))
    said = F.array(mention(F.lower("symbol"), (i % 3) / 2, F.col("price") / 100 - 0.5), mention(F.lit("market"), F.lit(0.1), F.lit(0.2)), mention(F.lit("bad"), F.lit("x"), F.lit("y")))
    articles = ticks(spark, sf_dir).select((i % 50).alias("page"), F.struct(when.alias("time_published"), said.alias("ticker_sentiment")).alias("a"), F.floor(i / 1000).alias("slice"))
    articles.groupBy("page", "slice").agg(F.collect_list("a").alias("feed")).select("feed").write.json(path)  # some twenty articles a page
    f = feeds.news_sentiment(spark, path)
    return f.select("symbol", "date", F.round("av_sent", 9).alias("av_sent"), F.round("av_relevance", 9).alias("av_relevance"), "av_n")
