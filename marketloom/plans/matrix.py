"""The feature table of production width, and what its blocks are worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry
from ..functions.num import r6
from ..operators.features import assembled, feature_columns, market_block, price_block
from ..operators.labels import uniqueness
from ..operators.training import block_ablation, fold_rows, stored, walk_forward
from ..registry import query
from ..sources.logical import bars, twin
from . import features as _single  # noqa: F401  (their twins make up the table's)
from .learning import events, stored_bars
from .models import learner

#: The single queries whose columns the price block has.
_PARTS = ("feat_sma", "feat_rvol", "feat_returns_gap", "feat_stoch_williams", "feat_bollinger", "feat_obv_volume", "feat_mfi", "feat_calendar", "feat_fracdiff", "feat_macd", "feat_rsi_wilder", "feat_atr", "feat_adx")


def market_series(spark, sf_dir, b: DataFrame | None = None) -> DataFrame:
    """One row per date: mean close, mean range and mean volume stand for the market's level, fear gauge and rate."""
    b = bars(spark, sf_dir) if b is None else b
    return b.groupBy("date").agg(F.avg("close").alias("level"), F.avg(F.col("high") - F.col("low")).alias("fear"), F.avg("volume").alias("rate"))


def _joined() -> str:
    parts = " ".join(("FROM" if i == 0 else "JOIN") + f" ({registry._ORACLES[name]}) {name}" + ("" if i == 0 else " USING (symbol, date)") for i, name in enumerate(_PARTS))
    return f"SELECT * EXCLUDE (month), round(sin(2 * pi() * (month - 1) / 12), 6) + 0 AS month_sin, round(cos(2 * pi() * (month - 1) / 12), 6) + 0 AS month_cos {parts}"


@query("price_matrix", _joined())
def price_matrix(spark, sf_dir) -> DataFrame:
    """All price features of every bar in one table."""
    p = price_block(bars(spark, sf_dir))
    return p.select("symbol", "date", *[r6(F.col(c)).alias(c) if c != "month_end" else F.col(c).cast("int").alias(c) for c in feature_columns(p)])


_D = "OVER (ORDER BY date"


@query("market_features", twin(f"""SELECT date, {', '.join(f"round(coalesce(ln(level / lag(level, {n}) {_D})), 0), 6) AS market_ret_{n}" for n in (1, 5, 20))}, round(coalesce((fear - avg(fear) OVER z) / nullif(CASE WHEN count(fear) OVER z >= 60 THEN stddev_samp(fear) OVER z END, 0), 0), 6) AS fear_z,
    round(coalesce(ln(nullif(fear, 0) / nullif(lag(fear) {_D}), 0)), 0), 6) AS fear_change, round(coalesce(rate - lag(rate) {_D}), 0), 6) AS rate_change FROM (SELECT date, avg(close) AS level, avg(high - low) AS fear, avg(volume) AS rate FROM bars GROUP BY date) WINDOW z AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"""))
def market_features(spark, sf_dir) -> DataFrame:
    """The block that all symbols share: level, fear gauge and rate."""
    m = market_block(market_series(spark, sf_dir))
    return m.select("date", *[r6(F.col(c)).alias(c) for c in m.columns if c != "date"])


def wide(spark, sf_dir, flags: dict[str, str] | None = None, b: DataFrame | None = None, **blocks: DataFrame) -> DataFrame:
    b = stored_bars(spark, sf_dir) if b is None else b
    return assembled({"market": market_series(spark, sf_dir, b), **blocks}, b, flags)


MARKET = ("market_ret_1", "market_ret_5", "market_ret_20", "fear_z", "fear_change", "rate_change", "rs_1", "rs_5")


def block_of(column: str) -> str:
    return "market" if column in MARKET else "price"


_PRICE = [f"sma_{n}" for n in (5, 10, 20, 50, 200)] + [f"ret_{n}" for n in (1, 5, 10, 20)] + ["rvol_5", "rvol_20", "stoch_k", "stoch_d", "roc_10", "williams_r", "bb_width", "bb_pct", "obv_slope", "volume_ratio", "mfi_14", "gap", "intraday", "dow_sin", "dow_cos", "month_sin", "month_cos", "month_end", "fracdiff_04", "macd", "macd_signal", "macd_hist", "rsi_14", "atr_14", "plus_di", "minus_di", "adx_14"]
_KNOWN = [f"SELECT '{c}' AS feature, 'price' AS block, count({c}) AS known FROM pm" for c in _PRICE] + [f"SELECT '{c}', 'market', count({'*' if c[:2] != 'rs' else 'ret_' + c[3:]}) FROM pm" for c in MARKET]


@query("feature_selection", f"WITH pm AS MATERIALIZED ({_joined()}) " + " UNION ALL ".join(_KNOWN))
def feature_selection(spark, sf_dir) -> DataFrame:
    """Which columns of the wide table are features, their block, and in how many bars each is known; raw and diagnostic columns are none."""
    table = wide(spark, sf_dir)
    names = feature_columns(table)
    counts = table.agg(*[F.count(c).alias(c) for c in names])
    one = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(block_of(c)).alias("block"), F.col(c).alias("known")) for c in names])
    return counts.select(F.inline(one))


def wide_events(spark, sf_dir) -> DataFrame:
    """Labelled events with all features and their uniqueness as weight."""
    b = stored_bars(spark, sf_dir)
    e = events(spark, sf_dir, b)
    rows = e.join(wide(spark, sf_dir, b=b).drop("open", "high", "low", "close", "volume", "ffd_order"), ["symbol", "date"]).join(uniqueness(e, b), ["symbol", "date"])
    return stored(rows.withColumn("y", (F.col("label") > 0).cast("double")).where("label <> 0"), "wide-events")


@query("ablation_of_blocks")
def ablation_of_blocks(spark, sf_dir) -> DataFrame:
    """What the price and the market block add to the out-of-fold ranking of the logistic base, on the same rows and folds."""
    rows = wide_events(spark, sf_dir)
    names = [c for c in rows.columns if c in _PRICE or c in MARKET]
    blocks = {b: [c for c in names if block_of(c) == b] for b in ("price", "market")}
    got = block_ablation(rows, learner("logistic"), blocks)
    out = spark.createDataFrame(got, "block string, columns int, auc_with double, auc_without double, lift double")
    return out.select("block", "columns", *[r6(F.col(c)).alias(c) for c in ("auc_with", "auc_without", "lift")])


#: Trees and depth of the model over all columns.
TREES, DEPTH = 50, 4


@query("oof_gbt_wide")
def oof_gbt_wide(spark, sf_dir) -> DataFrame:
    """Out-of-fold probabilities of boosted trees over all columns of the wide table, for the events that have all of them."""
    rows = wide_events(spark, sf_dir)
    names = [c for c in rows.columns if c in _PRICE or c in MARKET]
    scored = walk_forward(fold_rows(rows.dropna(subset=names)), learner("gbt", TREES, DEPTH), names)
    return scored.select("symbol", "date", "fold", "y", r6(F.col("p")).alias("p"))
