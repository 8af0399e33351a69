"""Lists, the gate before reports, and backups of several tables."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.operators.listing import report_gate, screened, transactions_like
from marketloom.sources.backups import backup_all, contents, restore_into, restored
from marketloom.sources.files import KeyedTable

D = date(2024, 3, 1)


def test_transactions_in_four_orders(spark):
    rows = [(1, "Rent March", "home", D, -900.0), (2, "Salary", "income", D + timedelta(1), 3000.0), (3, "RENT deposit", "home", D - timedelta(1), 900.0), (4, None, "home", D, -10.0), (5, "rent a car", "travel", D, -900.0)]
    tx = spark.createDataFrame(rows, "id int, title string, category string, tx_date date, amount double")
    ids = lambda **kw: [r.id for r in transactions_like(tx, **kw).collect()]
    assert ids() == [2, 1, 4, 5, 3] and ids(sort="date-asc") == [3, 1, 4, 5, 2]
    assert ids(sort="amount-desc") == [2, 1, 3, 5, 4] and ids(sort="amount-asc") == [4, 1, 3, 5, 2]
    assert ids(search="rEnT", category="home") == [1, 3] and ids(search="rent", sort="other") == [1, 3, 5]


def test_chips(spark):
    rows = [("Alpha", "A", None, "Tech", 0.0), ("Beta", "B", "alphabet", "tech", -1.0), ("Gamma", "G", "x", "Energy", None), (None, "alp", "", None, 2.0)]
    df = spark.createDataFrame(rows, "name string, symbol string, sub string, sector string, change double")
    names = lambda **kw: [r.symbol for r in screened(df, **kw).orderBy("symbol").collect()]
    assert names() == ["A", "B", "G", "alp"] and names(chip="gainers") == ["A", "G", "alp"] and names(chip="losers") == ["B"]
    assert names(chip="tech") == ["A", "B"] and names(search="ALP") == ["A", "B", "alp"] and names(search="alp", chip="losers") == ["B"]


def test_gate_before_the_next_report(spark):
    p = spark.createDataFrame([(i, s, D + timedelta(d), c, k) for i, (s, d, c, k) in enumerate([("A", 0, 61, 0.25), ("A", 4, 61, None), ("A", 10, 63, 0.1), ("A", 11, 60, 0.1), ("a", 3, 60, 0.1), ("B", 0, 60, 0.1), (None, 0, 60, 0.1)])], "id int, symbol string, date date, confidence int, kelly_frac double")
    calendar = spark.createDataFrame([("A", D - timedelta(30)), ("a", D + timedelta(10)), ("A", D + timedelta(10)), ("A", D + timedelta(40)), ("C", D), (None, D), ("B", None)], "symbol string, report_date date")
    got = {r.id: (r.days_to_report, r.near_report, r.confidence, r.kelly_frac) for r in report_gate(p, calendar).collect()}
    assert got == {0: (10, False, 61, 0.25), 1: (6, True, 30, None), 2: (0, True, 32, 0.05), 3: (29, False, 60, 0.1), 4: (7, False, 60, 0.1), 5: (None, False, 60, 0.1), 6: (None, False, 60, 0.1)}
    assert report_gate(p, calendar, window=7).where("near_report").count() == 3 and report_gate(p, calendar.limit(0)).where("near_report").count() == 0


def test_backup_of_several_tables(spark, tmp_path):
    a = spark.sql("select id, cast(id as decimal(12,2)) as amount, date_add(date'2024-01-01', cast(id as int)) as day, if(id = 2, null, concat('x', id)) as note from range(5)")
    b = spark.createDataFrame([("k", 1.5, [1, 2])], "name string, v double, list array<int>")
    empty = b.limit(0)
    path = str(tmp_path / "b")
    backup_all({"a": a, "b": b, "empty": empty}, path, {"db": "test"})
    assert {(r.name, r.n) for r in contents(spark, path).collect()} == {("a", 5), ("b", 1), ("empty", 0)} and '"db": "test"' in contents(spark, path).first().meta
    assert sorted(map(str, restored(spark, path, "a").collect())) == sorted(map(str, a.collect())) and restored(spark, path, "b").first().list == [1, 2] and restored(spark, path, "empty").count() == 0
    with pytest.raises(KeyError):
        restored(spark, path, "none")
    targets = {"a": KeyedTable(spark, str(tmp_path / "a"), ["id"], "id bigint, amount decimal(12,2), day date, note string"), "b": KeyedTable(spark, str(tmp_path / "bb"), ["name"], "name string, v double, list array<int>")}
    targets["a"].upsert(a.where("id >= 3").withColumn("note", F.lit("old")).unionByName(a.where("id = 0").withColumn("id", F.lit(77).cast("long"))), [F.col("id")])
    before = sorted(map(str, targets["a"].read().collect()))
    assert restore_into(spark, path, targets).count() == 3 and sorted(map(str, targets["a"].read().collect())) == before  # dry run
    restore_into(spark, path, targets, ["a"], apply=True)
    got = {r.id: r.note for r in targets["a"].read().collect()}
    assert got == {0: "x0", 1: "x1", 2: None, 3: "x3", 4: "x4", 77: "x0"} and targets["b"].read().count() == 0
    (tmp_path / "b" / "meta" / "_SUCCESS").unlink()
    with pytest.raises(ValueError):
        contents(spark, path)
