"""Lists as their users ask for them: searched, filtered by chip, sorted either way; and the gate before known report dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_forward

SORTS = ("date-desc", "date-asc", "amount-desc", "amount-asc")


def transaction_order(sort: str) -> list[Column]:
    """The four orders of a list of transactions (by date, or by size whatever the sign); ties keep the order of ids, other names too."""
    by = {"date": F.col("tx_date"), "amount": F.abs("amount")}.get(sort.split("-")[0])
    return [F.col("id")] if by is None or sort not in SORTS else [by.desc() if sort.endswith("desc") else by.asc(), F.col("id")]


def transactions_like(tx: DataFrame, search: str = "", category: str = "", sort: str = "date-desc") -> DataFrame:
    """Transactions whose title holds the text in either case of letters, in the category if one is given, in the order asked for."""
    rows = tx.where(F.lower(F.coalesce("title", F.lit(""))).contains(search.lower())) if search else tx
    rows = rows.where(F.col("category") == category) if category else rows
    return rows.orderBy(*transaction_order(sort))


def screened(rows: DataFrame, search: str = "", chip: str = "all") -> DataFrame:
    """Rows (name, symbol, sub, sector, change) that hold the text in name, symbol or sub; chips: all, gainers (change of 0 or more), losers, or a sector.

    An unknown change counts as 0.
    """
    change, text = F.coalesce("change", F.lit(0.0)), search.lower()
    found = rows.where(F.exists(F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "symbol", "sub")]), lambda x: x.contains(text))) if text else rows
    if chip == "all":
        return found
    return found.where(change >= 0 if chip == "gainers" else change < 0 if chip == "losers" else F.lower(F.coalesce("sector", F.lit(""))) == chip)


def report_gate(predictions: DataFrame, calendar: DataFrame, horizon: int = 5, window: int | None = None, factor: float = 0.5) -> DataFrame:
    """Predictions (symbol, date, confidence, kelly_frac and more) with days_to_report and near_report; confidence and stake are scaled near a report.

    ``calendar``: symbol, report_date.  Near is a next report, on the day itself or later, within ``window`` days (horizon + 1).  Symbols without a
    known report to come are not gated.
    """
    window = horizon + 1 if window is None else window
    known = calendar.select(F.upper("symbol").alias("_key"), F.col("report_date").alias("_at")).where("_key IS NOT NULL AND _at IS NOT NULL").distinct()
    rows = asof_forward(predictions.withColumns({"_key": F.upper("symbol"), "_at": F.col("date")}), known.withColumn("_next", F.col("_at")), ["_key"], "_at", ["_next"])
    days = F.datediff("_next", "date")
    rows = rows.withColumns({"days_to_report": days, "near_report": F.coalesce(days.between(0, window), F.lit(False))})
    near = F.col("near_report")
    out = rows.withColumn("confidence", F.when(near, F.bround(F.col("confidence") * F.lit(factor)).cast("int")).otherwise(F.col("confidence")))
    return out.withColumn("kelly_frac", F.when(near, F.round(F.col("kelly_frac") * factor, 4)).otherwise(F.col("kelly_frac"))).drop("_key", "_at", "_next")
