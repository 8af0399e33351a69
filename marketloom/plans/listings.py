"""Lists, chips, the gate before reports, and backups of several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import r6
from ..operators.listing import SORTS, report_gate, screened, transaction_order, transactions_like
from ..operators.portfolio import kelly_fraction
from ..registry import query
from ..sources.backups import backup_all, restore_into
from ..sources.files import KeyedTable, scratch
from ..sources.logical import bars, predictions, raw, ticks, transactions, twin

_ORDERS = {"date-desc": "tx_date DESC", "date-asc": "tx_date", "amount-desc": "abs(amount) DESC", "amount-asc": "abs(amount)"}


@query("tx_sorts", twin(" UNION ALL ".join(f"SELECT * FROM (SELECT '{s}' AS sort, row_number() OVER (ORDER BY {o}, id)::INT AS place, id, tx_date, amount FROM transactions WHERE contains(lower(title), '7') AND category = 'high') WHERE place <= 50" for s, o in _ORDERS.items())))
def tx_sorts(spark, sf_dir) -> DataFrame:
    """The first fifty of a searched list of transactions in each of its four orders."""
    out = None
    for sort in SORTS:
        page = transactions_like(transactions(spark, sf_dir), "7", "high", sort).limit(50)
        place = F.row_number().over(Window.orderBy(*transaction_order(sort)))  # fifty rows
        page = page.select(F.lit(sort).alias("sort"), place.alias("place"), "id", "tx_date", "amount")
        out = page if out is None else out.unionByName(page)
    return out


CHIPS = ("all", "gainers", "losers", "sector2")
_LAST = ("ch", "SELECT symbol, 'Asset ' || symbol AS name, 'sector' || (regexp_extract(symbol, '(\\d+)$', 1)::INT % 5)::VARCHAR AS sector, round(change, 6) AS change FROM (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS change FROM bars) WHERE change IS NOT NULL")


@query("screener_chips", twin("SELECT chip, symbol, count(*) AS n, round(sum(change), 4) AS total FROM (SELECT c.chip, ch.* FROM ch CROSS JOIN (SELECT unnest(['all', 'gainers', 'losers', 'sector2']) AS chip) c WHERE contains(lower(name), 'brand#1') AND CASE chip WHEN 'gainers' THEN change >= 0 WHEN 'losers' THEN change < 0 WHEN 'all' THEN true ELSE sector = chip END) GROUP BY ALL", _LAST))
def screener_chips(spark, sf_dir) -> DataFrame:
    """Moves of the symbols that a search finds, under every chip."""
    by = Window.partitionBy("symbol").orderBy("date")
    change = r6(F.try_divide("close", F.lag("close").over(by)) - 1)
    sector = F.concat(F.lit("sector"), (F.regexp_extract("symbol", r"(\d+)$", 1).cast("int") % 5).cast("string"))
    rows = bars(spark, sf_dir).select("symbol", F.concat(F.lit("Asset "), "symbol").alias("name"), F.lit(None).cast("string").alias("sub"), sector.alias("sector"), change.alias("change")).where("change is not null")
    out = None
    for chip in CHIPS:
        found = screened(rows, "Brand#1", chip).groupBy(F.lit(chip).alias("chip"), "symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("change"), 4).alias("total"))
        out = found if out is None else out.unionByName(found)
    return out


_KELLY = "CASE WHEN prob_up <= 0 OR prob_up >= 1 OR 2 * prob_up - 1 <= 0 THEN 0 ELSE least(0.5::DOUBLE, 0.25::DOUBLE * (2 * prob_up - 1)) END"


@query("reports_gate", twin(f"""SELECT id, CASE WHEN near_report THEN round_even(confidence * 0.5::DOUBLE, 0)::INT ELSE confidence END AS confidence, round(CASE WHEN near_report THEN round(k * 0.5::DOUBLE, 4) ELSE k END, 6) AS kelly_frac, days_to_report, near_report FROM (
  SELECT p.id, confidence, {_KELLY} AS k, (c.report_date - p.generated_at::DATE)::INT AS days_to_report, coalesce((c.report_date - p.generated_at::DATE) BETWEEN 0 AND 6, false) AS near_report
  FROM predictions p ASOF LEFT JOIN (SELECT DISTINCT symbol, ts::DATE + 9 AS report_date FROM ticks WHERE id % 97 = 0) c ON p.symbol = c.symbol AND p.generated_at::DATE <= c.report_date)"""))
def reports_gate(spark, sf_dir) -> DataFrame:
    """Confidence and stake of all predictions, halved in the week before the symbol's next report in a calendar."""
    calendar = ticks(spark, sf_dir).where("id % 97 = 0").select("symbol", F.date_add(F.to_date("ts"), 9).alias("report_date"))
    p = predictions(spark, sf_dir).select("id", "symbol", F.to_date("generated_at").alias("date"), "confidence", kelly_fraction(F.col("prob_up")).alias("kelly_frac"))
    return report_gate(p, calendar).select("id", "confidence", r6(F.col("kelly_frac")).alias("kelly_frac"), "days_to_report", "near_report")


@query("backup_tables", twin("SELECT 'bars' AS name, count(*) AS n, 0::BIGINT AS restored, 0::DOUBLE AS total FROM bars UNION ALL SELECT 'nation', count(*), count(*), round(sum(n_regionkey), 2)::DOUBLE FROM nation UNION ALL SELECT 'transactions', count(*), count(*), round(sum(amount), 2) FROM transactions"))
def backup_tables(spark, sf_dir) -> DataFrame:
    """Three tables in one backup, two of them restored: a dry run first, which writes nothing, then in earnest."""
    tables = {"bars": bars(spark, sf_dir), "nation": raw(spark, sf_dir, "nation"), "transactions": transactions(spark, sf_dir)}
    home = scratch(spark, "backups")
    backup_all(tables, f"{home}/files", {"of": "the day"})
    targets = {n: KeyedTable(spark, f"{home}/{n}", [k], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tables[n].schema), buckets=4) for n, k in (("nation", "n_nationkey"), ("transactions", "id"))}
    restore_into(spark, f"{home}/files", targets)
    if not all(t.read().isEmpty() for t in targets.values()):
        raise RuntimeError("a dry run has written")
    restore_into(spark, f"{home}/files", targets, ["nation", "transactions"], apply=True)
    found = restore_into(spark, f"{home}/files", targets)
    sums = targets["nation"].read().agg(F.lit("nation").alias("name"), F.count(F.lit(1)).alias("restored"), F.round(F.sum("n_regionkey").cast("double"), 2).alias("total"))
    sums = sums.unionByName(targets["transactions"].read().agg(F.lit("transactions").alias("name"), F.count(F.lit(1)).alias("restored"), F.round(F.sum("amount"), 2).alias("total")))
    return found.join(sums, "name", "left").select("name", "n", F.coalesce("restored", F.lit(0)).cast("long").alias("restored"), F.coalesce("total", F.lit(0.0)).alias("total"))
