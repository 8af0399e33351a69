"""Round trips through the file sources and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.files import KeyedTable, backup, epoch_day, read_csv, read_json_records, restore, scratch
from ..sources.logical import bars, news, raw, ticks, transactions, twin


@query("upsert_keep_latest", twin("SELECT symbol, day, price FROM (SELECT symbol, ts::DATE AS day, price, row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY (event_type IN ('click', 'view'))::INT DESC, ts DESC, id DESC) AS n FROM ticks) WHERE n = 1"))
def upsert_keep_latest(spark, sf_dir) -> DataFrame:
    """Two batches into one keyed table; the second replaces keys of the first."""
    t = ticks(spark, sf_dir).select("symbol", F.to_date("ts").alias("day"), "price", "ts", "id", F.col("event_type").isin("click", "view").alias("late"))
    store = KeyedTable(spark, scratch(spark, "upsert"), ["symbol", "day"], f"symbol string, day date, price double, ts {dict(t.dtypes)['ts']}, id bigint", buckets=4, part=F.col("day"))
    for late in (False, True):
        store.upsert(t.where(F.col("late") == late).drop("late"), [F.desc("ts"), F.desc("id")])
    return store.read().select("symbol", "day", "price")


@query("insert_ignore", twin("SELECT symbol, day, price FROM (SELECT symbol, ts::DATE AS day, price, row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY (event_type IN ('click', 'view'))::INT, ts, id) AS n FROM ticks) WHERE n = 1"))
def insert_ignore(spark, sf_dir) -> DataFrame:
    t = ticks(spark, sf_dir).select("symbol", F.to_date("ts").alias("day"), "price", "id", F.col("event_type").isin("click", "view").alias("late"))
    store = KeyedTable(spark, scratch(spark, "ignore"), ["symbol", "day"], "symbol string, day date, price double, id bigint", buckets=4, part=F.col("day"))
    for late in (False, True):
        store.insert_ignore(t.where(F.col("late") == late).drop("late"), [F.col("id")])
    return store.read().select("symbol", "day", "price")


@query("retention_prune", twin("SELECT id, symbol, price FROM ticks WHERE ts::DATE >= (SELECT max(ts::DATE) FROM ticks) - 7"))
def retention_prune(spark, sf_dir) -> DataFrame:
    t = ticks(spark, sf_dir).select("id", "symbol", "price", F.to_date("ts").alias("day"))
    last = t.agg(F.max("day")).first()[0]
    store = KeyedTable(spark, scratch(spark, "prune"), ["id"], "id bigint, symbol string, price double, day date")
    store.upsert(t, [F.col("id")])
    store.prune(F.col("day") >= F.date_sub(F.lit(last).cast("date"), 7))
    return store.read().select("id", "symbol", "price")


@query("csv_roundtrip", twin("SELECT symbol, date, close, volume FROM bars"))
def csv_roundtrip(spark, sf_dir) -> DataFrame:
    path = scratch(spark, "csv")
    bars(spark, sf_dir).select("symbol", "date", "close", "volume").write.csv(path, header=True)
    return read_csv(spark, path, {"symbol": "string", "date": "date", "close": "double", "volume": "double"})


@query("csv_headerless", twin("SELECT id, price FROM ticks"))
def csv_headerless(spark, sf_dir) -> DataFrame:
    """Files of which some start with a line of names."""
    path = scratch(spark, "plain")
    t = ticks(spark, sf_dir).select("id", "price")
    t.select(F.col("id").cast("string"), F.col("price").cast("string")).unionByName(spark.createDataFrame([("open_time", "value")], "id string, price string")).write.csv(path)
    return read_csv(spark, path, {"id": "bigint", "price": "double"}, header=False)


@query("json_timeline", twin("SELECT epoch_ms(epoch_ms(date_trunc('second', ts)))::DATE AS date, count(*)::BIGINT AS n, max(price) AS top FROM ticks GROUP BY ALL"))
def json_timeline(spark, sf_dir) -> DataFrame:
    """Nested feed: documents with an array of points whose time is epoch milliseconds; a symbol's points are dealt to documents of some thousands."""
    path = scratch(spark, "json")
    t = ticks(spark, sf_dir).select("symbol", F.struct((F.unix_seconds(F.col("ts").cast("timestamp")) * 1000).alias("t"), F.col("price").alias("v")).alias("p"))
    documents = max(1, t.count() // 5_000)
    t.groupBy("symbol", F.pmod(F.xxhash64("p"), F.lit(documents)).alias("part")).agg(F.collect_list("p").alias("data")).drop("part").write.json(path)
    points = read_json_records(spark, path, "data", "t: bigint, v: double")
    return points.groupBy(epoch_day(F.col("t")).alias("date")).agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))


@query("backup_restore", twin("SELECT id, user_id, tx_date, amount, category FROM transactions"))
def backup_restore(spark, sf_dir) -> DataFrame:
    t = transactions(spark, sf_dir).select("id", "user_id", "tx_date", "amount", "category")
    path = scratch(spark, "backup")
    backup(t, path)
    return restore(spark, path, t.schema)


@query("tsv_facts", "SELECT o_orderkey AS adsh, l_returnflag AS tag, round(sum(l_extendedprice), 2) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O') AND l_returnflag IN ('A', 'R') AND l_linestatus <> 'F' GROUP BY ALL")
def tsv_facts(spark, sf_dir) -> DataFrame:
    """Filings and facts as tab-separated files: form and tag white lists, consolidated rows only, joined on the filing."""
    sub, num = scratch(spark, "sub"), scratch(spark, "num")
    raw(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("adsh"), F.col("o_orderstatus").alias("form")).write.csv(sub, sep="\t", header=True)
    raw(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("adsh"), F.col("l_returnflag").alias("tag"), F.when(F.col("l_linestatus") == "F", "segment").alias("segments"), F.col("l_extendedprice").alias("value")).write.csv(num, sep="\t", header=True)
    filings = read_csv(spark, sub, {"adsh": "bigint", "form": "string"}, sep="\t").where(F.col("form").isin("F", "O"))
    facts = read_csv(spark, num, {"adsh": "bigint", "tag": "string", "segments": "string", "value": "double"}, sep="\t").where(F.col("tag").isin("A", "R") & F.col("segments").isNull())
    return facts.join(filings.select("adsh"), "adsh").groupBy("adsh", "tag").agg(F.round(F.sum("value"), 2).alias("v"))


@query("json_ticker_map", "SELECT upper(n_name) AS ticker, n_nationkey AS cik FROM nation WHERE n_regionkey < 3")
def json_ticker_map(spark, sf_dir) -> DataFrame:
    """A JSON object of objects as a table, cut to the known universe."""
    path = scratch(spark, "map")
    n = raw(spark, sf_dir, "nation").select(F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('": '), F.to_json(F.struct(F.col("n_name").alias("ticker"), F.col("n_nationkey").alias("cik_str")))).alias("e"))
    n.agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list("e")), ", "), F.lit("}")).alias("value")).write.text(path)  # a small dimension in one document, as the source ships it
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.map_values(F.from_json("value", "map<string, struct<ticker: string, cik_str: int>>"))).alias("r"))
    universe = raw(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("cik"))
    return rows.select(F.upper("r.ticker").alias("ticker"), F.col("r.cik_str").alias("cik")).join(universe, "cik").select("ticker", "cik")


@query("labelled_csv", twin("SELECT trim(text) AS sentence, CASE score WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS label FROM news WHERE score IS NOT NULL AND url % 3 <> 0"))
def labelled_csv(spark, sf_dir) -> DataFrame:
    """Labelled sentences: quoted text with line breaks, labels trimmed, lower-cased and checked against the known ones."""
    path = scratch(spark, "labelled")
    label = F.when(F.col("score") == 1, " Positive").when(F.col("score") == -1, "NEGATIVE ").otherwise("neutral")
    n = news(spark, sf_dir).where("score is not null").select(F.trim("text").alias("sentence"), F.when(F.col("url") % 3 == 0, "n/a").otherwise(label).alias("label"))
    n.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = spark.read.csv(path, header=True, multiLine=True, escape='"', schema="sentence string, label string")
    return back.select(F.coalesce("sentence", F.lit("")).alias("sentence"), F.lower(F.trim("label")).alias("label")).where(F.col("label").isin("positive", "negative", "neutral"))
