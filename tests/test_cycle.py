"""A day that is cut off and taken up again; the target book by hand."""

import math
import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.operators.book import basket_leverage, planned_orders, target_book, with_verdicts
from marketloom.operators.chain import Chain, Step

NAMES = ("resolve", "predict", "book", "verify", "paper")


class Killed(BaseException):
    """What no step catches."""


def steps(spark, made, stop=None, half=False, fail=()):
    def make(name):
        def run(done):
            assert list(done) == list(NAMES[: NAMES.index(name)])
            made.append(name)
            if name in fail:
                raise ValueError("no review today")
            before = done[NAMES[NAMES.index(name) - 1]].first().n if done else 0
            if name == stop:
                if half:  # the driver is lost while it writes
                    spark.range(3).select(F.lit(99).alias("n")).write.mode("overwrite").parquet(f"{half}/{name}")
                    (half / name / "_SUCCESS").unlink()
                raise Killed
            return spark.range(1).select(F.lit(before + len(made) * 0 + 1).alias("n"))

        return run

    return [Step(n, make(n), (lambda d: d["book"]) if n == "verify" else None) for n in NAMES]


@pytest.mark.parametrize("stop", NAMES)
@pytest.mark.parametrize("half", [False, True])
def test_a_killed_day_is_taken_up_where_it_was_cut_off(spark, tmp_path, stop, half):
    made: list[str] = []
    with pytest.raises(Killed):
        Chain(spark, str(tmp_path)).run(steps(spark, made, stop, tmp_path if half else False))
    again = Chain(spark, str(tmp_path))
    done = again.run(steps(spark, made))
    at = NAMES.index(stop)
    assert made == [*NAMES[: at + 1], *NAMES[at:]] and again.ran == list(NAMES[at:])  # what was done is not done twice
    assert [done[n].first().n for n in NAMES] == [1, 2, 3, 4, 5]
    last = Chain(spark, str(tmp_path))
    assert last.run(steps(spark, made)).keys() == done.keys() and last.ran == []


def test_a_failed_review_does_not_stop_the_day(spark, tmp_path):
    made: list[str] = []
    chain = Chain(spark, str(tmp_path))
    done = chain.run(steps(spark, made, fail=("verify",)))
    assert done["verify"].first().n == 3 and chain.status("verify") == "otherwise" and chain.status("paper") == "made"
    with pytest.raises(ValueError):
        Chain(spark, str(tmp_path / "other")).run(steps(spark, [], fail=("book",)))


def universe(spark, regime="trend", n=20):
    return spark.createDataFrame([(f"S{i:02d}", 0.40 + 0.01 * i, 60, regime) for i in range(n)] + [("NONE", None, 50, regime)], "symbol string, prob_up double, confidence int, regime string")


def history(spark, days=40):
    rows, by_day = [], []
    for d in range(days):
        x = {f"S{i:02d}": 0.01 * math.sin(d * (i + 1)) for i in range(20)}
        rows += [(s, date(2024, 1, 1) + timedelta(days=d), r) for s, r in x.items()]
        by_day.append((x["S18"] + x["S19"]) / 2)
    return spark.createDataFrame([*rows, ("S19", date(2024, 1, 1), None)], "symbol string, date date, ret double"), statistics.stdev(by_day[-20:])


def test_book_takes_the_top_decile_under_gate_and_lever(spark):
    returns, spread = history(spark)
    lever = min(3.0, 0.30 / math.sqrt(252) / spread)
    for regime, gate in (("trend", 1.0), ("chop", 0.6), ("risk_off", 0.25)):
        got = {r.symbol: r for r in target_book(universe(spark, regime), returns).collect()}
        assert set(got) == {"S18", "S19"}  # 20 valid names, the best tenth
        for r in got.values():
            assert r.weight == 0.5 and abs(r.target_frac - gate * lever * 0.5) < 1e-4 and abs(r.notional - 1e5 * gate * lever * 0.5) < 0.01
    few = target_book(universe(spark), returns.where("date < '2024-01-08'"))
    assert {r.target_frac for r in few.collect()} == {0.5}  # not enough dates: no lever
    bears = universe(spark).withColumn("prob_up", F.col("prob_up") - 0.2)
    assert target_book(bears, returns).count() == 0 and target_book(universe(spark).limit(0), returns).count() == 0
    one = target_book(universe(spark, n=3).withColumn("prob_up", F.col("prob_up") + 0.2), returns)
    assert [r.symbol for r in one.collect()] == ["S02"]  # at least one name
    tied = target_book(universe(spark).withColumn("prob_up", F.lit(0.7)), returns)
    assert sorted(r.symbol for r in tied.collect()) == ["NONE", "S00"]


def test_lever_is_capped_and_flat_baskets_have_none(spark):
    days = [date(2024, 1, 1) + timedelta(days=d) for d in range(30)]
    make = lambda size: spark.createDataFrame([("A", d, size * (-1) ** k) for k, d in enumerate(days)], "symbol string, date date, ret double")
    held = spark.createDataFrame([("A",)], "symbol string")
    assert basket_leverage(make(1e-6), held).first().leverage == 3.0
    assert basket_leverage(make(0.0), held).first().leverage == 1.0
    assert basket_leverage(make(0.1), held).first().leverage < 0.2


def test_reviews_only_take_away(spark):
    book = spark.createDataFrame([(s, 0.1, 60, 0.2, 0.2, 20_000.0) for s in "abcde"], "symbol string, edge double, confidence int, weight double, target_frac double, notional double")
    v = spark.createDataFrame([("a", True, None), ("b", False, 30), ("c", False, 90), ("d", None, None), ("z", True, 1)], "symbol string, veto boolean, final_confidence int")
    got = {r.symbol: (r.target_frac, r.notional) for r in with_verdicts(book, v).collect()}
    assert got == {"b": (0.1, 10_000.0), "c": (0.2, 20_000.0), "d": (0.2, 20_000.0), "e": (0.2, 20_000.0)}
    orders = {r.symbol: r.notional for r in planned_orders(book.withColumn("target_frac", F.expr("case symbol when 'a' then 0.05 when 'b' then 0.000001 when 'c' then 0.0 else 0.5 end"))).collect()}
    assert orders == {"A": 5000.0, "D": 10_000.0, "E": 10_000.0}
