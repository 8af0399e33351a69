"""Exact de-duplication against brute force, with colliding digests and hostile rows."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from marketloom.llm.exact_dedup import exact_duplicates

SCHEMA = "doc_id long, text string"
TEXTS = ["Same Text", "same text", "SAME TEXT", "ÄPFEL", "äpfel", "Äpfel", "", None, " ", "İstanbul", "istanbul", "K", "K", "own"]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, top, len(ids), i == top and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != top
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def hostile():
    rng = random.Random(3)
    rows = [(i, rng.choice([*TEXTS, f"text {rng.randint(0, 40)}", f"Text {rng.randint(0, 40)}"])) for i in range(300)]
    rows += [(None, "same text"), (None, "null ids only"), (None, "Null ids only"), (7, "twin"), (7, "Twin"), (7, "twin"), (-(2**63), "low"), (2**63 - 1, "high")]
    return rows + [(1000 + i, "hot " * 50) for i in range(200)] + [(2000, "x" * 2_000_000), (2001, "X" * 2_000_000)]


def test_groups_equal_brute_force(spark):
    df = spark.createDataFrame(hostile(), SCHEMA).repartition(7)
    assert got(exact_duplicates(df)) == brute(hostile())


def test_colliding_digests_are_told_apart_by_content(spark):
    digests = [lambda t: F.substring(F.md5(t), 1, 1), lambda t: F.lit("one digest for all")]
    for digest in digests:
        assert got(exact_duplicates(spark.createDataFrame(hostile(), SCHEMA).repartition(5), digest, salts=3)) == brute(hostile())


def test_empty_table_and_clashing_columns(spark):
    assert exact_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = hostile()[:60]
    names = ["_digest", "_norm", "_salt", "_spread", "_texts", "_row", "_first", "keep_id", "group_size", "kept", "text_sha256"]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(n) for n in names])
    assert got(exact_duplicates(df)) == brute(rows)


def test_all_rows_are_one_group(spark):
    rows = [(None, "a")] * 50 + [(3, "A")] * 20
    result = got(exact_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6)))
    assert result == brute(rows) and sum(r[3] for r in result) == 1
