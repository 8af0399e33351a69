"""Retrieval and text: similarity search, keyword routing, parsing, redaction, narratives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import r6
from ..operators.retrieval import PrunedIndex, context, per_collection
from ..operators.vectors import nearest_vectors
from ..registry import query
from ..sources.logical import news, predictions, raw, ticks, twin, verdicts



@query("cosine_topk", """WITH v AS (SELECT vec_id, label % 3 AS collection, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, v.collection, round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 6) AS score FROM v, v q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, vec_id, collection, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 4""")
def cosine_topk(spark, sf_dir) -> DataFrame:
    """Exact cosine neighbours in each collection of every vector whose id is divisible by 100."""
    v = raw(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).cast("int").alias("collection"), "embedding")
    return nearest_vectors(v, v.where("vec_id % 100 = 0"), 4)


_CHUNKS = 8
_SIMILAR = """v AS (SELECT vec_id, label % 3 AS collection, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, v.collection, v.label, round(list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))), 6) AS score FROM v, v q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, vec_id) AS k FROM s) WHERE k <= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY collection, score DESC, vec_id) AS at_ FROM t)"""


@query("retrieval_context", f"WITH {_SIMILAR} SELECT query_id, count(*) AS chunks, string_agg('[Context ' || at_::VARCHAR || '] item ' || vec_id::VARCHAR || ' of kind ' || label::VARCHAR, chr(10) || chr(10) ORDER BY at_) AS context FROM o WHERE at_ <= {_CHUNKS} GROUP BY query_id")
def retrieval_context(spark, sf_dir) -> DataFrame:
    """The numbered context of every query vector, by the pruned index: two neighbours of each collection, in the order of the collections."""
    e = raw(spark, sf_dir, "embeddings")
    v = e.select("vec_id", (F.col("label") % 3).cast("int").alias("collection"), "embedding")
    texts = e.select("vec_id", F.concat(F.lit("item "), F.col("vec_id").cast("string"), F.lit(" of kind "), F.col("label").cast("string")).alias("text"))
    found = PrunedIndex(v).search(v.where("vec_id % 100 = 0"), per_collection(_CHUNKS))
    return context(found, texts, _CHUNKS)


#: Keyword, symbol, priority: the first that matches wins.
KEYWORDS = (("the ", "EN1", 1), ("der ", "DE1", 2), (" la ", "FR1", 3), ("que", "ES1", 4), ("on", "ANY", 5))


@query("keyword_map", twin("SELECT url, CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{s}'" for k, s, _ in KEYWORDS) + " ELSE '' END AS ticker FROM news"))
def keyword_map(spark, sf_dir) -> DataFrame:
    ticker = F.coalesce(*[F.when(F.lower("text").contains(k), s) for k, s, _ in KEYWORDS], F.lit(""))
    return news(spark, sf_dir).select("url", ticker.alias("ticker"))


@query("routed_scores", twin("SELECT url, CASE WHEN n_chars % 2 = 0 THEN 'social' ELSE 'headline' END AS scorer, round(CASE WHEN n_chars % 2 = 0 THEN (n_chars % 11) / 10::DOUBLE - (n_chars % 7) / 10::DOUBLE ELSE (n_chars % 13) / 20::DOUBLE - (n_chars % 5) / 10::DOUBLE END, 6) AS score FROM news"))
def routed_scores(spark, sf_dir) -> DataFrame:
    """Texts go to the scorer of their class; a score is P(positive) - P(negative)."""
    n = news(spark, sf_dir).select("url", "n_chars")
    social = n.where("n_chars % 2 = 0").select("url", F.lit("social").alias("scorer"), ((F.col("n_chars") % 11) / 10).alias("p"), ((F.col("n_chars") % 7) / 10).alias("m"))
    head = n.where("n_chars % 2 <> 0").select("url", F.lit("headline").alias("scorer"), ((F.col("n_chars") % 13) / 20).alias("p"), ((F.col("n_chars") % 5) / 10).alias("m"))
    return social.unionByName(head).select("url", "scorer", r6(F.col("p") - F.col("m")).alias("score"))


#: The sentence in which a verdict is stored, and the URL parameters that hold secrets.
VERDICT = r"(?s)model says (\w+) @ (\d+)% \(regime ([^)]*)\)\.\s*Verifier:\s*(VETO|agree|downgrade)\s*→\s*final\s*(\d+)%\.\s*(.*?)\s*Risk:\s*(.*)$"
SECRETS = r"(?i)\b(token|apikey|api_key|x_cg_demo_api_key|x_cg_pro_api_key)=[^&\s'\"<>]+"
FIELDS = ("direction", "model_confidence", "regime", "label", "final_confidence", "rationale", "risks")


def parsed_verdict(line) -> list:
    """The seven fields of a stored verdict; NULL where the sentence is another one."""
    out = []
    for i, name in enumerate(FIELDS, 1):
        field = F.when(line.rlike(VERDICT), F.regexp_extract(line, VERDICT, i))
        out.append((field.cast("int") if name.endswith("confidence") else field).alias(name))
    return out


def redacted(line):
    return F.regexp_replace(line, SECRETS, "$1=***")


_MARK = "CASE label WHEN 'veto' THEN 'VETO' ELSE label END"
_LINE = f"CASE WHEN id % 16 = 0 THEN symbol || ': no verdict' ELSE symbol || ' — model says ' || CASE WHEN id % 3 = 0 THEN 'UP' ELSE 'DOWN' END || ' @ ' || llm_confidence::VARCHAR || '% (regime ' || CASE WHEN id % 5 = 0 THEN 'risk_off' ELSE 'trend' END || '). Verifier: ' || {_MARK} || ' → final ' || (llm_confidence // 2)::VARCHAR || '%. News is ' || sentiment || '.' || chr(10) || 'See above. Risk: gaps' || chr(10) || 'and halts' END"


def _verdict_sql() -> str:
    pattern = VERDICT.replace("'", "''")
    fields = [f"CASE WHEN regexp_matches(line, '{pattern}') THEN regexp_extract(line, '{pattern}', {i}){'::INTEGER' if n.endswith('confidence') else ''} END AS {n}" for i, n in enumerate(FIELDS, 1)]
    return f"SELECT id, symbol, {', '.join(fields)} FROM (SELECT id, symbol, {_LINE} AS line FROM verdicts)"


@query("verdict_parse", twin(_verdict_sql()))
def verdict_parse(spark, sf_dir) -> DataFrame:
    """Fields of stored verdict sentences, which may span lines; other sentences give NULLs."""
    i, say = F.col("id"), lambda c: F.col(c).cast("string")
    line = F.concat(
        F.col("symbol"), F.lit(" — model says "), F.when(i % 3 == 0, "UP").otherwise("DOWN"), F.lit(" @ "), say("llm_confidence"), F.lit("% (regime "), F.when(i % 5 == 0, "risk_off").otherwise("trend"), F.lit("). Verifier: "),
        F.when(F.col("label") == "veto", "VETO").otherwise(F.col("label")), F.lit(" → final "), F.floor(F.col("llm_confidence") / 2).cast("string"), F.lit("%. News is "), F.col("sentiment"), F.lit(".\nSee above. Risk: gaps\nand halts"),
    )
    v = verdicts(spark, sf_dir).select("id", "symbol", F.when(i % 16 == 0, F.concat("symbol", F.lit(": no verdict"))).otherwise(line).alias("line"))
    return v.select("id", "symbol", *parsed_verdict(F.col("line")))


_URL = "'GET /q?symbol=' || symbol || '&Token=abc' || id::VARCHAR || '&apikey=K' || id::VARCHAR || '&api_key=\"q\" x_cg_pro_api_key=z' || id::VARCHAR || chr(39) || ' mytoken=open X_CG_DEMO_API_KEY=9 ok'"


@query("redact", twin("SELECT id, regexp_replace(" + _URL + ", '" + SECRETS.replace("'", "''") + "', '\\1=***', 'g') AS line FROM ticks"))
def redact(spark, sf_dir) -> DataFrame:
    """Values of key-bearing parameters are masked, in either case of letters."""
    i = F.col("id").cast("string")
    line = F.concat(F.lit("GET /q?symbol="), F.col("symbol"), F.lit("&Token=abc"), i, F.lit("&apikey=K"), i, F.lit('&api_key="q" x_cg_pro_api_key=z'), i, F.lit("' mytoken=open X_CG_DEMO_API_KEY=9 ok"))
    return ticks(spark, sf_dir).select("id", redacted(line).alias("line"))


def narrative(name, symbol, price, change, cap, kind):
    """The sentence that stands for a price snapshot in the search index."""
    part = lambda form, c: F.format_string(form, F.bround(c, int(form.split(".")[-1][0])))  # noqa: E731  halves to even
    size = F.when(F.coalesce(cap, F.lit(0.0)) > 0, F.concat(F.lit(" Market cap: $"), part("%.1f", cap / 1e9), F.lit("B."))).otherwise("")
    way = F.when(F.coalesce(change, F.lit(0.0)) >= 0, "up").otherwise("down")
    return F.concat(F.coalesce(name, symbol), F.lit(" ("), symbol, F.lit(") is trading at "), part("%.4f", price), F.lit(", "), part("%.2f", F.abs(F.coalesce(change, F.lit(0.0)))), F.lit("% "), way, F.lit(" in 24h."), size, F.lit(" Asset type: "), F.coalesce(kind, F.lit("unknown")), F.lit("."))


@query("price_narrative", twin("""SELECT id, coalesce(name, symbol) || ' (' || symbol || ') is trading at ' || printf('%.4f', price) || ', ' || printf('%.2f', abs(coalesce(change, 0))) || '% ' || CASE WHEN coalesce(change, 0) >= 0 THEN 'up' ELSE 'down' END || ' in 24h.'
    || CASE WHEN cap > 0 THEN printf(' Market cap: $%.1fB.', cap / 1e9::DOUBLE) ELSE '' END || ' Asset type: ' || coalesce(kind, 'unknown') || '.' AS text
    FROM (SELECT id, symbol, price, CASE WHEN id % 4 <> 0 THEN 'Asset ' || symbol END AS name, CASE WHEN id % 7 <> 0 THEN (id % 201 - 100) / 8::DOUBLE END AS change, (id % 3) * (id % 1000) * 25e7::DOUBLE AS cap, CASE WHEN id % 5 <> 0 THEN event_type END AS kind FROM ticks)"""))
def price_narrative(spark, sf_dir) -> DataFrame:
    i = F.col("id")
    t = ticks(spark, sf_dir).select(
        "id", "symbol", "price", F.when(i % 4 != 0, F.concat(F.lit("Asset "), "symbol")).alias("name"), F.when(i % 7 != 0, (i % 201 - 100) / 8).alias("change"), ((i % 3) * (i % 1000) * 25e7).alias("cap"), F.when(i % 5 != 0, F.col("event_type")).alias("kind"),
    )
    return t.select("id", narrative(F.col("name"), F.col("symbol"), F.col("price"), F.col("change"), F.col("cap"), F.col("kind")).alias("text"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, sf_dir) -> DataFrame:
    return raw(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("tolerant_json", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE least(1, greatest(-1, CAST(json_extract_string(props, '$.k') AS INTEGER) / 50::DOUBLE - 1)) END AS score FROM events")
def tolerant_json(spark, sf_dir) -> DataFrame:
    """Fenced or broken model output: fences are stripped, what does not parse is NULL, scores are clamped."""
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n{\"k\": "), F.lit("oops"))).otherwise(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    k = F.from_json(F.regexp_replace(broken, r"^```(?:json)?\s*|\s*```$", ""), "k int")["k"]
    return raw(spark, sf_dir, "events").select("event_id", F.when(k.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), k / 50 - 1))).alias("score"))


@query("chat_window", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role <> 'system') WHERE k <= 40")
def chat_window(spark, sf_dir) -> DataFrame:
    """The last 40 messages of each conversation, system messages left out."""
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return raw(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("k", k).where("k <= 40").select("conv_id", "turn", "role")


@query("earnings_gate", twin("SELECT id, CASE WHEN gap BETWEEN 0 AND 6 THEN round(confidence * 0.5::DOUBLE, 2) ELSE confidence::DOUBLE END AS confidence, gap BETWEEN 0 AND 6 AS near FROM (SELECT id, confidence, (DATE '2024-01-25' - generated_at::DATE)::INT AS gap FROM predictions)"))
def earnings_gate(spark, sf_dir) -> DataFrame:
    """Confidence is halved within a week before a known report date."""
    gap = F.datediff(F.lit("2024-01-25").cast("date"), F.to_date("generated_at"))
    return predictions(spark, sf_dir).select("id", F.when(gap.between(0, 6), F.round(F.col("confidence") * 0.5, 2)).otherwise(F.col("confidence").cast("double")).alias("confidence"), gap.between(0, 6).alias("near"))
