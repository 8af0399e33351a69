"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The token budget flows down a domain - language - source tree.  At every node it is split among the
children by weight; a child that cannot use its share (its tokens times ``max_epochs`` fall short) leaves
the rest to its siblings, and only what a whole subtree cannot use goes to the siblings of its parent.
That is a capped proportional split per node.  Children are ordered by cap over weight, and prefix sums over
ranges of all nodes of a level tell which are filled; no task holds all children of a node.
A leaf with q full epochs and a remainder r takes each document q times, and the first r tokens of a
seeded shuffle of epoch q.  Splits are exact integers: the shares of a node sum to its budget.

Target weights are given per level as a table with a column ``weight`` (whole numbers) and any of the level's own and the upper
levels' names; a node that the table lacks weighs 1, and one that weighs 0 or less (or null) takes nothing.  A level without
a table weighs its nodes by floor(sqrt(tokens)), at least 1.  Tokens are counted as ``ceil(bytes / 4)`` unless a column
of counts is given (such as ``n_tokens`` of the token counts); null or negative counts are 0.  The document that crosses the
remainder is selected, and ``used_tokens`` counts only the tokens inside the budget.

Defined cases: null lang, source or domain is the branch ``und``; documents without tokens (null and empty texts)
are never selected; equal rows are separate rows (ordered by id, then text hash); rows that tie in all of these
are interchangeable; an empty table gives an empty result.  Further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, stored, text_or_empty, with_prefix_sums

LEVELS = ("domain", "lang", "source")
#: Production targets of languages inside each domain; other languages weigh 1.
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "es": 2, "fr": 2}


def source_domain(source: Column) -> Column:
    """Production rule for the domain: five consecutive source numbers form a domain."""
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit("und")).otherwise(F.concat(F.lit("domain"), F.floor(number.cast("long") / 5).cast("string")))


def _split(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split ``budget`` of each parent over its children (``cap``, ``weight``): capped shares, exact in integers."""
    big = lambda c: c.cast("decimal(19,0)")
    group = [F.col(c) for c in parent] or [F.lit(0).alias("_root")]
    keys = parent or ["_root"]
    nodes = nodes.withColumn("_ratio", F.col("cap") / F.col("weight"))
    out = with_prefix_sums(nodes, [*parent, "_ratio", name], {"_caps": "cap", "_weights": "weight"}, "mix-nodes").withColumn("_root", F.lit(0))
    sums = out.groupBy(*keys).agg(F.min("_caps").alias("_caps0"), F.min("_weights").alias("_weights0"), F.sum("weight").alias("_all"))
    out = salted_join(out, sums, keys, name)
    left, rest = F.col("budget") - (F.col("_caps") - F.col("_caps0")), F.col("_all") - (F.col("_weights") - F.col("_weights0"))
    out = stored(out.withColumn("_filled", big(F.col("cap")) * big(rest) <= big(F.col("weight")) * big(left)), "mix-filled")
    filled = F.col("_filled")
    sums = out.groupBy(*keys).agg(F.sum(F.when(filled, F.col("cap")).otherwise(0)).alias("_used"), F.sum(F.when(filled, F.col("weight")).otherwise(0)).alias("_done"))
    out = salted_join(out, sums, keys, name)
    upto = F.col("_weights") - F.col("_weights0") - F.col("_done")  # of the open siblings before this one: filled ones come first
    out = out.withColumn("_a", big(F.col("budget") - F.col("_used"))).withColumn("_b", big(F.col("_all") - F.col("_done")))
    out = out.withColumn("_lo", big(upto)).withColumn("_hi", big(upto + F.col("weight")))
    return out.withColumn("share", F.expr("if(_filled, cap, if(_b = 0, 0L, _a * _hi div _b - _a * _lo div _b))"))


def _weighted(nodes: DataFrame, level: str, weights: dict[str, DataFrame]) -> DataFrame:
    """Add ``weight`` to the nodes (with ``tokens``) of a level."""
    if level not in weights:
        return nodes.withColumn("weight", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("tokens").cast("double"))).cast("long")))
    given = weights[level]
    keys = [c for c in LEVELS if c in given.columns]
    given = given.groupBy(*keys).agg(F.max(F.coalesce(F.col("weight"), F.lit(0))).cast("long").alias("weight"))
    return nodes.join(given, keys, "left").withColumn("weight", F.greatest(F.lit(0), F.coalesce("weight", F.lit(1))).cast("long"))


def leaf_budgets(leaves: DataFrame, budget_share: float, max_epochs: int, weights: dict[str, DataFrame] | None = None) -> DataFrame:
    """Propagate the budget (a share of all tokens, in thousandths) from the root to the leaves (domain, lang, source, tokens)."""
    weights, per_mille = weights or {}, int(round(budget_share * 1000))
    parents = leaves.agg(F.expr(f"coalesce(sum(cast(tokens as decimal(19,0))) * {per_mille} div 1000, 0L)").alias("budget"))
    for depth in range(1, len(LEVELS) + 1):  # a leaf under a node that weighs nothing takes no part
        if (level := LEVELS[depth - 1]) in weights:
            nodes = _weighted(leaves.groupBy(*LEVELS[:depth]).agg(F.sum("tokens").alias("tokens")), level, weights)
            leaves = leaves.join(nodes.where("weight > 0").select(*LEVELS[:depth]), list(LEVELS[:depth]), "left_semi")
    for depth in range(1, len(LEVELS) + 1):
        keys, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).withColumn("cap", F.col("tokens") * max_epochs)
        nodes = _weighted(nodes, LEVELS[depth - 1], weights)
        nodes = salted_join(nodes, parents, parent, keys[-1]) if parent else nodes.crossJoin(F.broadcast(parents))  # the root is one row
        parents = _split(nodes, parent, keys[-1]).select(*keys, *(["tokens"] if depth == len(LEVELS) else []), F.col("share").alias("budget"))
    return parents


def mix_sources(
    docs: DataFrame, seed: int = 42, budget_share: float = 1.0, max_epochs: int = 2, domain: Column | None = None, weights: dict[str, DataFrame] | None = None, tokens: Column | None = None
) -> DataFrame:
    """Documents that the mix takes: id, branch, tokens, copies (epochs that include it) and used_tokens."""
    domain = source_domain(F.col("source")) if domain is None else domain
    tokens = F.expr("(octet_length(coalesce(text, '')) + 3) div 4") if tokens is None else tokens
    base = docs.select("doc_id", F.coalesce(domain, F.lit("und")).alias("domain"), *[F.coalesce(F.col(c), F.lit("und")).alias(c) for c in LEVELS[1:]], tokens.cast("long").alias("tokens"), F.md5(text_or_empty()).alias("_text"))
    base = stored(base.where("tokens > 0"), "mix-base")
    leaves = stored(base.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "mix-leaves")
    plan = with_prefix_sums(leaf_budgets(leaves, budget_share, max_epochs, weights), list(LEVELS), {"_start": "tokens"}, "mix-plan")
    plan = stored(plan.select(*LEVELS, "_start", F.expr("budget div tokens").alias("_full"), F.expr("budget % tokens").alias("_rest")), "mix-plan")
    picked = salted_join(base, plan, list(LEVELS), "_text").withColumn("_turn", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    picked = with_prefix_sums(picked, [*LEVELS, "_turn", "doc_id", "_text"], {"_before": "tokens"}, "mix-order")
    picked = picked.withColumn("_inside", F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("_rest") - (F.col("_before") - F.col("_start")))))
    picked = picked.withColumn("copies", (F.col("_full") + F.when(F.col("_inside") > 0, 1).otherwise(0)).cast("int")).where("copies > 0")
    return picked.select("doc_id", *LEVELS, "tokens", "copies", (F.col("_full") * F.col("tokens") + F.col("_inside")).alias("used_tokens"), "_text")


def target_weights(spark: SparkSession) -> dict[str, DataFrame]:
    """The production targets, as tables of weights."""
    rows = ", ".join(f"('{lang}', {weight}L)" for lang, weight in sorted(LANGUAGE_WEIGHTS.items()))
    return {"lang": spark.sql(f"SELECT * FROM VALUES {rows} AS t(lang, weight)")}


_BIG = "HUGEINT"


def _sql_split(src: str, parent: tuple[str, ...], keys: tuple[str, ...]) -> str:
    by = f"PARTITION BY {', '.join(parent)} " if parent else ""
    order = f"{by}ORDER BY cap::DOUBLE / weight, {keys[-1]}"
    return f"""(SELECT {', '.join(keys)}, tokens, CASE WHEN full_ THEN cap ELSE hi - lo END::BIGINT AS budget FROM (
      SELECT *, CASE WHEN open_ = 0 THEN 0 ELSE spare::{_BIG} * upto // open_ END AS hi, CASE WHEN open_ = 0 THEN 0 ELSE spare::{_BIG} * (upto - weight) // open_ END AS lo FROM (
        SELECT *, budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ({by}) AS spare, sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({by}) AS open_,
          sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER ({order} ROWS UNBOUNDED PRECEDING) AS upto FROM (
          SELECT *, cap::{_BIG} * weights <= weight::{_BIG} * left_ AS full_ FROM (
            SELECT *, budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
              sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM {src}))))) """


def _sql_nodes(keys: tuple[str, ...], parent: str, parent_keys: tuple[str, ...]) -> str:
    joined = f"JOIN {parent} p USING ({', '.join(parent_keys)})" if parent_keys else f"CROSS JOIN {parent} p"
    names = ", ".join(keys)
    weight = "greatest(1, floor(sqrt(n.tokens::DOUBLE))::BIGINT)"
    if keys[-1] == "lang":
        weight = f"CASE n.lang {' '.join(f"WHEN '{k}' THEN {w}" for k, w in LANGUAGE_WEIGHTS.items())} ELSE 1 END"
    return f"(SELECT n.*, p.budget, n.tokens * 2 AS cap, {weight} AS weight FROM (SELECT {names}, sum(tokens)::BIGINT AS tokens FROM leaves GROUP BY {names}) n {joined})"


MIX_SQL = f"""
WITH base AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '(\\d+)$', 1) = '' THEN 'und'
    ELSE 'domain' || (regexp_extract(source, '(\\d+)$', 1)::BIGINT // 5)::VARCHAR END AS domain, coalesce(lang, 'und') AS lang, coalesce(source, 'und') AS source,
    ((octet_length(encode(coalesce(text, ''))) + 3) // 4)::BIGINT AS tokens, md5(coalesce(text, '')) AS th FROM documents),
docs_ AS (SELECT * FROM base WHERE tokens > 0),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM docs_ GROUP BY ALL),
root AS (SELECT sum(tokens)::BIGINT AS budget FROM leaves),
l1 AS (SELECT domain, budget FROM {_sql_split(_sql_nodes(LEVELS[:1], 'root', ()), (), LEVELS[:1])}),
l2 AS (SELECT domain, lang, budget FROM {_sql_split(_sql_nodes(LEVELS[:2], 'l1', LEVELS[:1]), LEVELS[:1], LEVELS[:2])}),
l3 AS (SELECT * FROM {_sql_split(_sql_nodes(LEVELS, 'l2', LEVELS[:2]), LEVELS[:2], LEVELS)}),
turned AS (SELECT d.*, l3.budget // l3.tokens AS q, l3.budget % l3.tokens AS r,
    md5(concat_ws('|', '42', (l3.budget // l3.tokens)::VARCHAR, coalesce(d.doc_id::VARCHAR, ''))) AS turn FROM docs_ d JOIN l3 USING (domain, lang, source)),
placed AS (SELECT *, greatest(0, least(tokens, r - coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY turn, doc_id, th ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS inside FROM turned)
SELECT doc_id, domain, lang, source, tokens, (q + CASE WHEN inside > 0 THEN 1 ELSE 0 END)::INTEGER AS copies, (q * tokens + inside)::BIGINT AS used_tokens
FROM placed WHERE q + CASE WHEN inside > 0 THEN 1 ELSE 0 END > 0
"""
