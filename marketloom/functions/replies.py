"""Scores out of a model's reply: a JSON array that may be fenced, wrapped in prose, short, out of order or broken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .num import clip

#: Scores from here on are positive, from its negative down negative.
THRESHOLD = 0.15


def score_label(score: Column) -> Column:
    return F.when(score >= THRESHOLD, "positive").when(score <= -THRESHOLD, "negative").otherwise("neutral")


def reply_scores(reply: Column, n: Column) -> Column:
    """One (label, score) for each of the ``n`` texts that were asked about.

    What lies between the first ``[`` and the last ``]`` is read as a JSON array.  An object's ``i`` says which text it is about; where ``i`` is no whole
    number or out of range, its place in the array does, and if that is out of range too it is left out.  Scores (numbers or numbers as text;
    0 if missing) are clamped to -1 ... 1 and rounded to four digits; other scores and elements that are no objects are left
    out.  Of several objects about one text the last counts.  All else is neutral with 0, the whole reply too if it is null or no array can be read.
    """
    # Nothing is read twice: every step hands its values on as elements of an array, since a lambda's argument is computed once, an expression at each use.
    items = F.coalesce(F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), "array<string>"), F.array().cast("array<string>"))
    whole = r'(?s)"i"\s*:\s*(-?\d{1,9}|true|false)\s*[,}]'

    def parsed(item: Column, place: Column) -> Column:
        fields = F.when(item.startswith("{"), F.from_json(item, "map<string,string>"))
        return F.struct(place.alias("place"), fields.alias("fields"), F.regexp_extract(item, whole, 1).alias("raw"))

    def typed(x: Column) -> Column:
        i = F.when(x["raw"] == "true", 1).when(x["raw"] == "false", 0).otherwise(x["raw"].try_cast("int"))
        score = F.when(F.map_contains_key(x["fields"], F.lit("score")), x["fields"]["score"].try_cast("double")).when(x["fields"].isNotNull(), 0.0)
        return F.struct(x["place"].alias("place"), i.alias("i"), score.alias("score"))

    def read(x: Column) -> Column:
        at = F.when((x["i"] >= 0) & (x["i"] < n), x["i"]).when(x["place"] < n, x["place"])
        return F.struct(at.alias("at"), F.round(clip(x["score"], -1.0, 1.0), 4).alias("score"))

    usable = F.filter(F.transform(F.transform(F.transform(items, parsed), typed), read), lambda x: x["at"].isNotNull() & x["score"].isNotNull())

    def of(found: Column, k: Column) -> Column:
        return F.coalesce(F.get(F.reverse(F.filter(found, lambda x: x["at"] == k)), F.lit(0))["score"], F.lit(0.0))

    scores = F.get(F.transform(F.array(usable), lambda found: F.transform(F.sequence(F.lit(0), n - 1), lambda k: of(found, k))), F.lit(0))
    scores = F.transform(scores, lambda x: F.struct(score_label(x).alias("label"), x.alias("score")))
    return F.when(n > 0, scores).otherwise(F.array().cast("array<struct<label:string,score:double>>"))
