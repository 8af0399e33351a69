"""Removal of repeated multi-line chunks with content-defined boundaries, in DataFrame functions only.

Hashes of the lines roll through a window of three; a line ends a chunk where its hash is the smallest of its window.  Boundaries
therefore follow the content and survive shifts, every chunk but the last holds two lines at least, and a run of lines that
two documents share is cut alike inside, wherever it stands.  Chunks of two or more lines that
occur more than once keep their first occurrence (smallest doc_id, then text hash, then position); the
others go once their bytes have been compared with the kept chunk, so a hash collision removes nothing.

Hashes alone are shuffled to find repeats.  For the comparison the repeated chunks travel as text to the kept copy of each, and the places
to drop come back; the work on a document is linear in its lines.  What is repeated but not cut off as a whole chunk stays: single lines, and the first and last lines of a shared run.

Defined cases: null text is an empty one, null ``doc_id`` sorts first; rows equal in id and text are one
document (both rows get its result, and neither counts as a repeat of the other); equal hashes in a window are no
boundary; a text of any length goes whole; an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

def _chunked(docs: DataFrame) -> DataFrame:
    """doc_id, _text hash and chunks: array of (text, n_lines) that join with newlines to the text."""
    out = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # transform(array(x), v -> ...)[0] binds x once; a plain column would be evaluated anew for every element
    hashed = "transform(split(text, '\n', -1), l -> struct(l as line, cast(conv(substring(md5(l), 1, 8), 16, 10) as bigint) as h))"
    ends = "filter(sequence(1, size(s)), i -> i = size(s) or (i > 1 and s[i - 1].h < s[greatest(i - 2, 0)].h and s[i - 1].h < s[least(i, size(s) - 1)].h))"
    cut = "transform(e, (x, i) -> struct(array_join(transform(slice(s, if(i = 0, 1, e[greatest(i - 1, 0)] + 1), x - if(i = 0, 0, e[greatest(i - 1, 0)])), y -> y.line), '\n') as text, x - if(i = 0, 0, e[greatest(i - 1, 0)]) as n))"
    return out.select("doc_id", "text", F.md5("text").alias("_text"), F.expr(f"transform(array({hashed}), s -> transform(array({ends}), e -> {cut})[0])[0]").alias("chunks"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_chunks, n_removed_lines, clean_text."""
    rows = _chunked(docs)
    seen = rows.select("doc_id", "_text", F.posexplode("chunks").alias("_no", "_chunk")).where("_chunk.n >= 2")
    seen = seen.select("doc_id", "_text", "_no", F.md5("_chunk.text").alias("_key")).distinct()
    seen = stored(seen, "line-chunks")
    first = seen.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("doc_id", "_text", "_no")).alias("_first")).where("_n > 1").select("_key", "_first")
    first = stored(first, "line-repeats")
    # texts of the repeated chunks: each document is asked for its own, and those of equal rows are fetched once
    place = F.struct("doc_id", "_text", "_no")
    asked = seen.join(first, "_key").select("doc_id", "_text", F.struct("_no", "_key", (place == F.col("_first")).alias("_kept")).alias("_ask"))
    asked = asked.groupBy("doc_id", "_text").agg(F.collect_list("_ask").alias("_asked"))
    found = rows.join(asked, ["doc_id", "_text"]).dropDuplicates(["doc_id", "_text"])  # before the exchange on the key, so that Spark can split a hot chunk's rows in the join
    found = found.select("doc_id", "_text", F.explode(F.expr("transform(_asked, a -> struct(a._no, a._key, a._kept, chunks[a._no].text as _chunk))")).alias("x")).select("doc_id", "_text", "x.*")
    found = stored(found, "line-texts")
    kept = found.where("_kept").select("_key", F.col("_chunk").alias("_first_chunk"))
    gone = found.where("NOT _kept").join(kept, "_key").where("_chunk = _first_chunk").groupBy("doc_id", "_text").agg(F.collect_list("_no").alias("_gone"))
    out = rows.join(gone, ["doc_id", "_text"], "left")
    # places, not texts, come back: the difference of two lists of places is linear in them
    left = "transform(if(_gone is null, sequence(0, size(chunks) - 1), array_except(sequence(0, size(chunks) - 1), _gone)), i -> chunks[i])"
    out = out.withColumn("_left", F.expr(left))
    lines = "aggregate({}, 0, (n, c) -> n + c.n)"
    return out.select(
        F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id"), F.expr(lines.format("chunks")).alias("n_lines"), F.size("chunks").alias("n_chunks"),
        (F.expr(lines.format("chunks")) - F.expr(lines.format("_left"))).alias("n_removed_lines"), F.expr("array_join(transform(_left, c -> c.text), '\\n')").alias("clean_text"),
    )


LINES_SQL = """
WITH d AS (SELECT DISTINCT coalesce(doc_id, -9223372036854775808) AS doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS th FROM documents),
l AS (SELECT doc_id, th, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
b AS (SELECT *, coalesce(h < lag(h) OVER w AND h < lead(h) OVER w, false) AS ends FROM h WINDOW w AS (PARTITION BY doc_id, th ORDER BY i)),
c AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, th ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM b),
chunk AS (SELECT doc_id, th, no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS ctext FROM c GROUP BY ALL),
marked AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY ctext, n >= 2 ORDER BY doc_id, th, no) > 1 AS gone FROM chunk),
r AS (SELECT doc_id, th, sum(n)::INTEGER AS n_lines, count(*)::INTEGER AS n_chunks, coalesce(sum(n) FILTER (WHERE gone), 0)::INTEGER AS n_removed_lines,
   coalesce(string_agg(ctext, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS clean_text FROM marked GROUP BY ALL)
SELECT CASE WHEN r.doc_id <> -9223372036854775808 THEN r.doc_id END AS doc_id, n_lines, n_chunks, n_removed_lines, sha256(clean_text) AS clean_sha256
FROM documents o JOIN r ON r.doc_id = coalesce(o.doc_id, -9223372036854775808) AND r.th = md5(coalesce(o.text, ''))
"""
