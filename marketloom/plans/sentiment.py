"""Sentiment of texts: keyword tables, scorers by class of text, and scores out of model replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import reply_scores
from ..operators.keywords import first_keyword
from ..operators.scoring import BUCKETS, CERTAIN, fit, routed
from ..registry import query
from ..sources.logical import news, raw, ticks, twin


@query("keyword_table", twin("""SELECT url, f.symbol, f.keyword FROM (SELECT url FROM news) a LEFT JOIN (SELECT url, symbol, keyword FROM (
    SELECT n.url, k.symbol, k.keyword, row_number() OVER (PARTITION BY n.url ORDER BY k.priority, k.keyword, k.symbol) AS r FROM news n JOIN k ON contains(lower(n.text), k.keyword)) WHERE r = 1) f USING (url)""",
    ("k", "SELECT * FROM (SELECT DISTINCT item_id AS priority, 'I' || item_id::VARCHAR AS symbol, unnest(string_split(lower(text), ' ')) AS keyword FROM benchmark) WHERE length(keyword) >= 6")))
def keyword_table(spark, sf_dir) -> DataFrame:
    """Symbol of each news text by a table of keywords: the long words of the benchmark's items, the first item wins."""
    items = raw(spark, sf_dir, "benchmark").select(F.col("item_id").alias("priority"), F.concat(F.lit("I"), F.col("item_id").cast("string")).alias("symbol"), F.explode(F.split(F.lower("text"), " ")).alias("keyword"))
    return first_keyword(news(spark, sf_dir).select("url", "text"), items.where(F.length("keyword") >= 6), ["url"])


def text_class(symbol):
    """Texts of sources with odd numbers are social posts, all others headlines."""
    return F.when(F.regexp_extract(symbol, r"(\d+)$", 1).try_cast("long") % 2 == 1, "social").otherwise("headline")


def labelled_news(spark, sf_dir) -> DataFrame:
    """url, text, kind and label: toxic texts are negative, good ones positive, the others that were judged neutral."""
    label = F.when(F.col("score") < 0, "negative").when(F.col("score") > 0, "positive").when(F.col("score") == 0, "neutral")
    return news(spark, sf_dir).select("url", "text", text_class(F.coalesce("symbol", F.lit(""))).alias("kind"), label.alias("label"))


_SCORES = (
    ("ln", "SELECT url, text, CASE WHEN try_cast(regexp_extract(coalesce(symbol, ''), '(\\d+)$', 1) AS BIGINT) % 2 = 1 THEN 'social' ELSE 'headline' END AS kind, CASE WHEN score < 0 THEN 'negative' WHEN score > 0 THEN 'positive' WHEN score = 0 THEN 'neutral' END AS label FROM news"),
    ("wd", f"SELECT DISTINCT url, kind, label, ('0x' || substr(md5(word), 1, 8))::BIGINT % {BUCKETS} AS b FROM (SELECT url, kind, label, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ0-9]+')) AS word FROM ln)"),
    ("kl", "SELECT * FROM (SELECT DISTINCT kind FROM ln WHERE label IS NOT NULL) CROSS JOIN (VALUES ('positive', 0), ('neutral', 1), ('negative', 2)) v(label, o)"),
    ("tx", "SELECT *, sum(n) OVER (PARTITION BY kind) AS whole FROM (SELECT kl.kind, kl.label, o, count(l.url) AS n FROM kl LEFT JOIN ln l ON l.kind = kl.kind AND l.label = kl.label GROUP BY ALL)"),
    ("pr", "SELECT kind, label, o, ln((n + 1) / sum(n + 1) OVER (PARTITION BY kind)) AS p FROM tx"),
    ("hb", "SELECT kind, b, label, count(*) AS n FROM wd WHERE label IS NOT NULL GROUP BY ALL"),
    ("od", """SELECT kind, label, b, y + 0.5::DOUBLE AS y, n - y + 0.5::DOUBLE AS no, t - y + 0.5::DOUBLE AS ot, whole - n - t + y + 0.5::DOUBLE AS wo FROM (
      SELECT tx.kind, tx.label, tx.n, whole, k.b, k.t, coalesce(hb.n, 0) AS y FROM tx JOIN (SELECT kind, b, sum(n) AS t FROM hb GROUP BY ALL) k ON k.kind = tx.kind LEFT JOIN hb ON hb.kind = tx.kind AND hb.label = tx.label AND hb.b = k.b)"""),
    ("wt", f"SELECT kind, label, b, ln(y / no) - ln(ot / wo) AS w FROM od WHERE abs(ln(y / no) - ln(ot / wo)) >= {CERTAIN} * sqrt(1 / y + 1 / no + 1 / ot + 1 / wo)"),
    ("sc", "SELECT u.url, wt.label, sum(wt.w) AS s FROM wd u JOIN wt ON wt.kind = u.kind AND wt.b = u.b GROUP BY ALL"),
    ("pb", "SELECT url, label, o, exp(s - max(s) OVER (PARTITION BY url)) AS e FROM (SELECT l.url, pr.label, pr.o, pr.p + coalesce(sc.s, 0) AS s FROM ln l JOIN pr ON pr.kind = l.kind LEFT JOIN sc ON sc.url = l.url AND sc.label = pr.label WHERE l.text <> '')"),
    ("rs", "SELECT url, arg_max(label, (e, -o)) AS label, round(sum(CASE label WHEN 'positive' THEN e WHEN 'negative' THEN -e ELSE 0 END) / sum(e), 4) AS score FROM pb GROUP BY url"),
)


@query("text_scores", twin("SELECT ln.url, kind, coalesce(rs.label, 'neutral') AS label, coalesce(score, 0) AS score FROM ln LEFT JOIN rs USING (url)", *_SCORES))
def text_scores(spark, sf_dir) -> DataFrame:
    """Label and P(positive) - P(negative) of every news text by the scorer of its class, fitted on the judged texts."""
    rows = labelled_news(spark, sf_dir)
    held = spark.sparkContext.broadcast(fit(rows, "text", "kind", "label"))
    loaders = {kind: (lambda kind=kind: held.value[kind]) for kind in held.value}
    default = "headline" if "headline" in loaders else next(iter(loaders), "headline")
    return rows.select("url", "kind", routed(F.col("text"), F.col("kind"), loaders, default).alias("r")).select("url", "kind", "r.label", "r.score")


_CASES = """SELECT id, pos, CASE WHEN s >= 0.15::DOUBLE THEN 'positive' WHEN s <= -0.15::DOUBLE THEN 'negative' ELSE 'neutral' END AS label, s AS score FROM (SELECT id, pos, coalesce(CASE id % 8
  WHEN 0 THEN CASE pos WHEN 0 THEN least(k, 1) WHEN 1 THEN -0.2::DOUBLE END WHEN 1 THEN CASE pos WHEN 2 THEN least(k, 1) WHEN 0 THEN greatest(-k, -1) END WHEN 2 THEN CASE pos WHEN 1 THEN least(k, 1) END
  WHEN 4 THEN CASE pos WHEN 0 THEN -1 WHEN 2 THEN 0.4::DOUBLE END WHEN 6 THEN CASE pos WHEN 1 THEN 0.9::DOUBLE END WHEN 7 THEN CASE pos WHEN 0 THEN least(k, 1) END END, 0)::DOUBLE + 0 AS s
  FROM (SELECT id, (id % 29) / 20::DOUBLE AS k, unnest([0, 1, 2]) AS pos FROM ticks))"""


@query("reply_scores", twin(_CASES))
def scores_of_replies(spark, sf_dir) -> DataFrame:
    """The three scores that each of a stream of model replies holds; eight kinds of replies, most of them damaged."""
    i, k = F.col("id"), F.col("k")
    forms = [
        F.concat(F.lit('Here you are:\n```json\n[{"i": 0, "score": '), k, F.lit('}, {"i": 1, "score": -0.2}]\n``` Anything else?')),
        F.concat(F.lit('[{"i": 2, "score": '), k, F.lit('}, {"i": 0, "score": -'), k, F.lit("}]")),
        F.concat(F.lit('[7, {"i": 40, "score": "'), k, F.lit('"}, null, {"i": -3, "score": 0.5}]')),  # places instead of numbers; the last is out of range
        F.concat(F.lit("I cannot score these ("), k, F.lit(").")),
        F.lit('[{"i": 0, "score": -7}, {"i": 1, "score": "high"}, {"i": 2, "score": 0.4, "why": "[sic]"}]'),
        F.concat(F.lit('[{"i": 0, "score": '), k, F.lit("}, {")),
        F.lit('[{"i": 0}, {"i": 1, "score": 0.1}, {"i": 1, "score": 0.9}, {"i": 2, "score": null}]'),
        F.concat(F.lit('[{"score": '), k, F.lit("}]")),
    ]
    reply = reduce(lambda c, f: c.when(i % 8 == f[0], f[1]), enumerate(forms), F)
    t = ticks(spark, sf_dir).select("id", F.format_string("%.2f", i % 29 / 20).alias("k"))
    t = t.select("id", F.posexplode_outer(reply_scores(reply, F.lit(3))).alias("pos", "r"))  # three scores a reply; without outer the array is computed again to test that it is not empty
    return t.select("id", "pos", "r.label", (F.col("r.score") + 0.0).alias("score"))  # no negative zero
