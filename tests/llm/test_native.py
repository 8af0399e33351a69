"""Sharding, line dedup and mixing against brute force, on hostile small tables."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from marketloom.llm.line_dedup import dedup_lines
from marketloom.llm.mixing import leaf_budgets, mix_sources
from marketloom.llm.sharding import shard_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as size", "2 as shard", "3 as tokens", "4 as copies")


def hostile(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["x" * rng.randint(1, 90), "same text", "same text", None, ""]), rng.choice(["en", "de", None]), rng.choice(["src1", "src7", "odd", None]), 1) for i in range(n)]
    return rows + [(None, "null id", "en", "src1", None), (5, "twin id", "en", "src1", 3), (5, "twin id", "en", "src1", 3)]


def minimax(sizes, n):
    def fits(cap):
        used, left = 1, cap
        for s in sizes:
            if s > left:
                used, left = used + 1, cap
            left -= s
        return used <= n

    return next(c for c in range(max(max(sizes), -(-sum(sizes) // n)), sum(sizes) + 1) if fits(c))


def check_shards(spark, rows, n=16):
    got = shard_documents(docs(spark, rows), n).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r[0]), size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    by_text, filled, slots = {}, {}, {}
    for r in got:
        assert by_text.setdefault((r.text_crc32, r.size), r.shard) == r.shard  # a group is never split
        filled[r.shard] = filled.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = {}
    for r in rows:
        first, total = groups.get(r[1] or "", (r[0], 0))
        groups[r[1] or ""] = (min((x for x in (first, r[0]) if x is not None), default=None), total + size(r[1]))
    order = [v for _, v in sorted(((-1 if f is None else f, hashlib.sha256(t.encode()).hexdigest()), v) for t, (f, v) in groups.items())]
    assert max(filled.values()) <= minimax(order, n)
    return filled


def test_shards_meet_the_minimax_capacity(spark):
    for n in (1, 3, 16):
        check_shards(spark, hostile(), n)


def test_oversize_group_leaves_no_shard_empty(spark):
    rows = [(i, "hot " * 40, "en", "s", 1) for i in range(20)] + [(100 + i, f"t{i}" * 10, "en", "s", 1) for i in range(60)]
    assert len(check_shards(spark, rows, 8)) == 8


def test_sharding_an_empty_table(spark):
    assert shard_documents(docs(spark, [])).count() == 0


def chunks(text):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if i + 1 == len(lines) or (i and h[i] < h[i - 1] and h[i] < h[i + 1]):
            out.append(lines[start : i + 1])
            start = i + 1
    return out


def test_line_chunks_go_after_their_first_occurrence(spark):
    rng = random.Random(2)
    pool = ["\n".join(f"line {rng.randint(0, 400)}" for _ in range(8)) for _ in range(4)]
    rows = [(i, "\n".join(rng.choice([*pool, f"own {i}\nown too {i}", ""]) for _ in range(4)), "en", "s", 1) for i in range(40)]
    rows += [(None, pool[0], "en", "s", 1), (90, None, "en", "s", 1), (91, "", "en", "s", 1), (3, rows[3][1], "en", "s", 1), (3, rows[3][1], "en", "s", 1)]
    seen, want = set(), {}
    for i, text in sorted({(-1 if r[0] is None else r[0], r[1] or "") for r in rows}, key=lambda x: (x[0], hashlib.md5(x[1].encode()).hexdigest())):
        kept, gone = [], 0
        for c in chunks(text):
            if len(c) >= 2 and "\n".join(c) in seen:
                gone += len(c)
            else:
                kept.append("\n".join(c))
            seen.add("\n".join(c))
        want[i, text] = ("\n".join(kept), gone, len(text.split("\n")))
    got = dedup_lines(docs(spark, rows)).collect()
    assert sorted((r.clean_text, r.n_removed_lines, r.n_lines) for r in got) == sorted(want[-1 if r[0] is None else r[0], r[1] or ""] for r in rows)
    assert any(r.n_removed_lines for r in got)
    assert dedup_lines(docs(spark, [])).count() == 0


def test_shift_keeps_most_boundaries():
    text = "\n".join(f"line {i * 7919 % 1000}" for i in range(200))
    a, b = {tuple(c) for c in chunks(text)}, {tuple(c) for c in chunks("new first line\n" + text)}
    assert len(a - b) <= 2


def test_runs_shared_inside_other_lines_go(spark):
    rng = random.Random(6)
    own = lambda i, k: "\n".join(f"own {i} {k} {rng.random()}" for _ in range(rng.randint(3, 9)))
    shared = [f"shared {j} {rng.random()}" for j in range(40)]
    got = dedup_lines(docs(spark, [(i, "\n".join([own(i, 0), *shared, own(i, 1)]), "en", "s", 1) for i in range(12)])).collect()
    by = {r.doc_id: r for r in got}
    assert by[0].n_removed_lines == 0
    for i in range(1, 12):  # all of the run but its first and last chunk
        left = [x for x in by[i].clean_text.split("\n") if x.startswith("shared")]
        assert len(left) <= 14 and by[i].n_removed_lines == 40 - len(left) and sum(x.startswith("own") for x in by[i].clean_text.split("\n")) == by[i].n_lines - 40


def test_shortage_goes_to_siblings_before_the_parents_siblings(spark):
    leaves = spark.createDataFrame([("d1", "en", "a", 1000), ("d1", "en", "b", 10), ("d1", "de", "c", 1000), ("d2", "en", "d", 1000)], "domain string, lang string, source string, tokens long")
    plan = {r.source: r.budget for r in leaf_budgets(leaves, 0.5, 1).collect()}
    assert sum(plan.values()) == 1505 and plan["b"] <= 10
    domain1 = 1505 * 44 // (44 + 31)  # weights are floor(sqrt(tokens)): 44 and 31
    assert abs(plan["a"] + plan["b"] + plan["c"] - domain1) <= 1
    assert plan["a"] + plan["b"] == (domain1 * 31 // (31 + 31)) or abs(plan["a"] + plan["b"] - plan["c"]) <= 1


def test_mix_takes_exact_budgets(spark):
    rows = [(i, "w" * (40 + i), "en" if i % 3 else "de", f"src{i % 9}", 1) for i in range(200)] + [(None, "x" * 50, None, None, 1), (7, None, "en", "src1", 1), (9, "w" * 49, "de", "src0", 1), (9, "w" * 49, "de", "src0", 1)]
    got = mix_sources(docs(spark, rows), budget_share=0.6, max_epochs=2).collect()
    tokens = sum((len(r[1] or "") + 3) // 4 for r in rows)
    assert sum(r.used_tokens for r in got) == int(tokens * 600 / 1000)
    assert all(1 <= r.copies <= 2 and 0 < r.used_tokens <= r.copies * r.tokens for r in got)
    again = mix_sources(docs(spark, rows[::-1]), budget_share=0.6, max_epochs=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix_sources(docs(spark, [])).count() == 0


def test_given_weights_are_met_to_the_token(spark):
    leaves = [("d1", "en", "a", 1000), ("d1", "en", "b", 1000), ("d1", "de", "c", 1000), ("d2", "en", "d", 1000), ("d3", "en", "e", 5000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {
        "domain": spark.createDataFrame([("d1", 3), ("d2", 1), ("d3", 0)], "domain string, weight long"),
        "lang": spark.createDataFrame([("en", 2), ("de", 1)], "lang string, weight long"),
        "source": spark.createDataFrame([("d1", "a", 3), ("d1", "b", 1)], "domain string, source string, weight long"),
    }
    got = {r.source: r.budget for r in leaf_budgets(df, 0.2, 1, weights).collect()}  # 9000 tokens, 1800 of them to take
    assert got == {"a": 675, "b": 225, "c": 450, "d": 450}  # 1350 : 450, then 900 : 450, then 675 : 225
    got = {r.source: r.budget for r in leaf_budgets(df, 0.3, 1, weights).collect()}  # 2700: d1 2025, of it en 1350, a would get 1012
    assert got == {"a": 1000, "b": 350, "c": 675, "d": 675}  # a's shortage goes to b, its sibling
    got = {r.source: r.budget for r in leaf_budgets(df, 0.4, 1, weights).collect()}  # 3600: d1 2700, en 1800, a full, b 800
    assert got == {"a": 1000, "b": 800, "c": 900, "d": 900}
    assert sum(r.budget for r in leaf_budgets(df, 1.0, 1, weights).collect()) == 4000  # all that d1 and d2 have; d3 takes nothing


def test_token_counts_can_be_given(spark):
    rows = [(i, "w" * 40, "en", "src1", 1) for i in range(30)]
    df = docs(spark, rows).withColumn("n", F.when(F.col("doc_id") < 10, F.col("doc_id")))  # others null
    got = mix_sources(df, budget_share=1.0, max_epochs=1, tokens=F.col("n")).collect()
    assert sorted((r.doc_id, r.tokens, r.used_tokens) for r in got) == [(i, i, i) for i in range(1, 10)]


def test_removal_is_linear_in_a_documents_lines(spark):
    """Two copies of 120,000 lines: minutes if every chunk looked through all the others."""
    text = "\n".join(f"line {i * 7919 % 999_983} of many" for i in range(120_000))
    got = {r.doc_id: r for r in dedup_lines(docs(spark, [(1, text, "en", "s", 1), (2, text + "\nown end", "en", "s", 1)])).collect()}
    assert got[1].clean_text == text and got[2].n_lines == 120_001 and got[2].n_removed_lines >= 119_990
    assert got[2].clean_text.endswith("own end") and got[2].n_removed_lines + got[2].clean_text.count("\n") + 1 == 120_001
