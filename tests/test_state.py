"""State over several micro-batches: a cache whose values expire, upserts that come once, results cached by their inputs."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marketloom.sources.cache import SourceCache, fingerprint
from marketloom.sources.files import KeyedTable
from marketloom.streaming import jobs

T0 = datetime(2024, 1, 1)
SCHEMA = "key string, id long, ts timestamp, op string, value double, ttl int"


def feed(spark, folder, batches, schema):
    """One file per micro-batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        newest = max(folder.glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + k, 1_700_000_000 + k))


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_values_expire_when_time_passes_without_a_request(spark, tmp_path):
    batches = [
        [("a", 1, at(0), "set", 1.0, 60), ("a", 2, at(30), "get", None, None), ("b", 3, at(0), "set", 2.0, 1000), ("c", 4, at(5), "set", 3.0, 60), ("c", 5, at(6), "invalidate", None, None), (None, 6, at(6), "set", 9.0, 60)],
        [("a", 7, at(60), "get", None, None), ("x", 8, at(100), "get", None, None), ("b", 9, at(70), "set", 2.5, 100)],  # 60: the deadline itself
        [("x", 10, at(300), "get", None, None), ("d", 11, at(300), "set", 4.0, None), ("d", 12, at(301), "get", None, None)],  # the watermark passes a's and b's deadlines after this
        [("x", 13, at(310), "get", None, None), ("a", 14, at(310), "get", None, None)],
        [("a", 15, at(320), "set", 5.0, 60), ("a", 16, at(321), "get", None, None), ("b", 17, at(325), "get", None, None)],
    ]
    feed(spark, tmp_path / "in", batches, SCHEMA)
    ops = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "10 seconds")
    out = jobs.drain(jobs.expiring_cache(ops), "cache").collect()
    got = {r.id: (r.result, r.value) for r in out if r.id is not None}
    assert got == {2: ("hit", 1.0), 7: ("hit", 1.0), 8: ("miss", None), 10: ("miss", None), 12: ("miss", None), 13: ("miss", None), 14: ("miss", None), 16: ("hit", 5.0), 17: ("miss", None)}
    assert sorted((r.key, r.value) for r in out if r.result == "expired") == [("a", 1.0), ("b", 2.5)]  # c was invalidated, the last a lives


def test_stream_upserts_come_once(spark, tmp_path):
    schema = "k int, v int, seq long"
    feed(spark, tmp_path / "in", [[(1, 1, 1), (2, 1, 2)], [(1, 2, 3)], [(3, 1, 4), (2, 5, 5), (2, 4, 6)]], schema)
    table = lambda: KeyedTable(spark, str(tmp_path / "t"), ["k"], schema, buckets=2)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: jobs.upsert_into(stream(), table(), [F.desc("seq")], "feed", str(tmp_path / "c"))
    rows = lambda: {r.k: r.v for r in table().read().collect()}
    run()
    want = {1: 2, 2: 4, 3: 1}
    assert rows() == want and table().last_batch("feed") == 2
    versions = table()._versions()
    run()  # nothing new
    assert table()._versions() == versions
    # the driver is lost between the last write and the stream's commit: Spark runs that batch again
    for name in ("2", ".2.crc"):
        (tmp_path / "c" / "commits" / name).unlink(missing_ok=True)
    run()
    assert rows() == want and table()._versions() == versions
    feed(spark, tmp_path / "in", [[(4, 9, 7), (1, 3, 8)]], schema)
    run()
    assert rows() == want | {4: 9, 1: 3} and table().last_batch("feed") == 3


def test_results_are_built_again_when_their_inputs_change(spark, tmp_path):
    source, built = tmp_path / "src", []
    spark.range(5).coalesce(1).write.parquet(str(source))
    cache = SourceCache(spark, str(tmp_path / "cache"))

    def build():
        built.append(1)
        return spark.read.parquet(str(source)).groupBy().count()

    get = lambda **kw: cache.get("rows", [str(source)], build, **kw).first()[0]
    assert get() == 5 and get() == 5 and len(built) == 1 and cache.hits == 1
    assert SourceCache(spark, str(tmp_path / "cache")).get("rows", [str(source)], build).first()[0] == 5 and len(built) == 1  # another session's object
    assert get(rebuild=True) == 5 and len(built) == 2
    before = fingerprint(spark, [str(source)])
    spark.range(3).coalesce(1).write.mode("append").parquet(str(source))
    assert fingerprint(spark, [str(source)]) != before
    assert get() == 8 and len(built) == 3
    broken = next((tmp_path / "cache" / "rows" / fingerprint(spark, [str(source)])).glob("_SUCCESS"))
    broken.unlink()  # a build that was cut off
    assert get() == 8 and len(built) == 4
    cache.drop_stale("rows", [str(source)])
    assert len(list((tmp_path / "cache" / "rows").iterdir())) == 1 and get() == 8 and len(built) == 4
    assert fingerprint(spark, [str(tmp_path / "absent")]) == "nothing"
