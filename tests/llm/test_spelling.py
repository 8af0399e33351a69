"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marketloom.llm import spelling
from marketloom.llm.spelling import Words, least_shared, near_words, spelling_forms, word_counts

SCHEMA = "doc_id long, text string"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_words(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        top = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top and words[top] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def check(spark, rows, **kwargs):
    names = ["word", "n", "form", "root", "near", "best", "key", "cell", "m", "side", "_next", "_moved", "a", "b"]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in names]).repartition(3)
    got = spelling_forms(df, **kwargs)
    assert got.columns == COLUMNS
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == brute(rows)
    return got


def variants(rng, base, letters):
    """Words one or two edits from one of the base words."""
    word = rng.choice(base)
    for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
        at, kind = rng.randint(0, len(word) - 1), rng.choice("idr")
        word = word[:at] + (rng.choice(letters) if kind != "d" else "") + word[at + (kind != "i") :]
    return word


def corpus(seed, letters, lengths, n=3000, docs=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(30)]
    base += [base[0] + "s", "x" + base[1], base[2][:-1], base[3] * 3, "a" * 7, "a" * 8, "a" * 60, "a" * 59, base[4] * 9]
    texts = [[] for _ in range(docs)]
    for _ in range(n):
        word = variants(rng, base, letters)
        rng.choice(texts).append(rng.choice([word, word.upper() if word.isascii() else word, word.capitalize()]))
    return [(rng.choice([i, i, i, None]), rng.choice([" ", ", ", "\n", "-", "5"]).join(t)) for i, t in enumerate(texts)]


def hostile():
    rows = corpus(1, "abc", [5, 6, 7]) + [(5, None), (5, ""), (6, "12 34 ßß × ÷÷÷÷÷ ĀĀĀĀĀ"), (None, None)]
    return rows + [(7, "Émilie émilie ÉMILIE emilie Emilie"), (7, "Émilie émilie ÉMILIE emilie Emilie")] * 4


def test_forms_equal_brute_force(spark):
    got = check(spark, hostile())
    assert any(r[1] and r[2] != r[1] for r in got)  # chains of forms
    check(spark, corpus(2, "abcdefghijéß÷", [5, 8, 11, 12, 13, 20]))


def test_hot_lists_in_blocks_lose_nothing(spark):
    check(spark, corpus(3, "ab", [5, 6, 9]), block=7)
    family = [(i, " ".join([f"internation{a}{b}"] * 3)) for i, (a, b) in enumerate((a, b) for a in "abcdefghijklmnop" for b in "abcdefghijklmnop")]
    check(spark, family, block=20)


def test_small_work_units(spark, monkeypatch):
    rows = corpus(4, "abcd", [5, 7, 10], n=1500)
    words = word_counts(spark.createDataFrame(rows, SCHEMA)).selectExpr("encode(word, 'ISO-8859-1') AS word", "n")
    batch = spelling.postings
    assert batch
    expected = {tuple(sorted((a, b))) for a in brute_words(rows) for b in brute_words(rows) if a < b and one_edit(a, b)}
    got = [(bytes(r.a).decode("latin-1"), bytes(r.b).decode("latin-1")) for r in near_words(words).collect()]
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == expected
    # lists cut at every place in small pieces, in this process
    import itertools

    w = Words(pa.array([w.encode("latin-1") for w in brute_words(rows)], pa.binary()))
    row, m, key = spelling.postings(w, np.zeros(spelling.SLOTS, np.int64))
    order = np.argsort(key, kind="stable")
    columns = [key[order].view(np.int64), np.zeros(len(key), np.int64), m[order].astype(np.int32), np.zeros(len(key), np.int8)]
    table = pa.Table.from_arrays([*map(pa.array, columns), pa.array([w.words[i] for i in row[order]], pa.binary()), pa.array(row[order])], ["key", "cell", "m", "side", "word", "n"])
    monkeypatch.setattr(spelling, "ROWS_AT_ONCE", 50)
    monkeypatch.setattr(spelling, "PAIRS_AT_ONCE", 10)
    found = itertools.chain.from_iterable(zip(b.column("a").to_pylist(), b.column("b").to_pylist()) for b in spelling._joiner(iter(table.to_batches(max_chunksize=13))))
    assert {tuple(sorted((a.decode("latin-1"), b.decode("latin-1")))) for a, b in found} == expected


def test_near_words_share_enough_grams():
    for m in range(5, 40):
        assert least_shared(np.array([m]))[0] >= 2


def test_empty_tables_and_long_texts(spark):
    assert spelling_forms(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling_forms(spark.createDataFrame([(1, None), (2, "few short words")], SCHEMA)).count() == 0
    rng = random.Random(8)
    long = " ".join(rng.choice(["pattern", "patern", "patterns", "other", "others"]) for _ in range(400_000))
    check(spark, [(1, long), (2, "z" * 2_500_000), (3, "z" * 2_500_000 + " " + "z" * 2_500_000), (4, "z" * 2_499_999 + " pattern")])
