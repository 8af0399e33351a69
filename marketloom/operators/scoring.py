"""Text scorers: one model per class of text, loaded once per worker; and a linear scorer that is fitted here.

A scorer takes texts and gives for each the probabilities of positive, neutral and negative.  ``routed`` sends every text to the scorer of its class
through an iterator pandas UDF: a worker loads a class's scorer when it first meets the class and keeps it.  A class without a scorer, or one whose
scorer cannot be loaded, takes the default's.

``fit`` counts the texts that hold each hashed word, per class and label, in one aggregation (at most classes x labels x BUCKETS rows come back).  A
word weighs its log odds ratio between the texts of a label and those of the others where that is CERTAIN standard errors from
zero, and nothing elsewhere, so that the many rare words of a long text do not drown the few that tell.  A text's evidence for a label is the
label's log share plus the weights of its distinct words.
"""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

LABELS = ("positive", "neutral", "negative")
BUCKETS = 1 << 18
CERTAIN = 3.0
Scorer = Callable[[list[str]], np.ndarray]
RESULT = "label string, score double"


def routed(text: Column, kind: Column, loaders: dict[str, Callable[[], Scorer]], default: str) -> Column:
    """(label, score) of each text by its class's scorer: the likeliest label, and P(positive) - P(negative) to four digits.

    A null or empty text is neutral with 0.  Ties of labels go to the first of positive, neutral, negative.
    """

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Scorer] = {}

        def scorer(name: str) -> Scorer:
            if name not in loaded:
                try:
                    loaded[name] = loaders[name]()
                except Exception as error:
                    if name == default:
                        raise
                    log.warning("no scorer for %s (%s), taking that of %s", name, error, default)
                    loaded[name] = scorer(default)
            return loaded[name]

        for texts, kinds in batches:
            out = pd.DataFrame({"label": "neutral", "score": np.zeros(len(texts))})
            some = texts.notna() & (texts != "")
            for name in kinds[some].fillna(default).unique():
                at = np.flatnonzero(some & (kinds.fillna(default) == name))
                p = scorer(name if name in loaders else default)(texts.iloc[at].tolist())
                out.iloc[at, 0] = [LABELS[k] for k in p.argmax(1)]
                out.iloc[at, 1] = np.round(p[:, 0] - p[:, 2], 4)
            yield out

    return run(text, kind)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-zà-ÿ0-9]+"), lambda x: x != "")


def bucket(word: Column) -> Column:
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")


class WordWeights:
    """Evidence of labels from the presence of hashed words: one weight per label and bucket."""

    def __init__(self, texts: np.ndarray, holding: np.ndarray):
        """``texts``: texts per label; ``holding``: those with a word of the bucket, per label."""
        self.prior = np.log((texts + 1) / (texts + 1).sum())
        yes, no = holding + 0.5, texts[:, None] - holding + 0.5
        other, without = holding.sum(0) - holding + 0.5, (texts.sum() - texts)[:, None] - (holding.sum(0) - holding) + 0.5
        ratio = np.log(yes / no) - np.log(other / without)
        self.weights = np.where(np.abs(ratio) >= CERTAIN * np.sqrt(1 / yes + 1 / no + 1 / other + 1 / without), ratio, 0.0)
        self.buckets: dict[str, int] = {}

    def _bucket(self, word: str) -> int:
        found = self.buckets.get(word)
        if found is None:
            if len(self.buckets) > 500_000:
                self.buckets.clear()
            found = self.buckets[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % BUCKETS
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), len(LABELS)))
        for i, text in enumerate(texts):
            at = sorted({self._bucket(w) for w in set(_WORD.findall(text.lower()))})
            s = self.prior + self.weights[:, at].sum(1)
            s = np.exp(s - s.max())
            out[i] = s / s.sum()
        return out


_WORD = re.compile("[a-zà-ÿ0-9]+")


def fit(labelled: DataFrame, text: str, kind: str, label: str) -> dict[str, WordWeights]:
    """A scorer per class from rows whose ``label`` is one of LABELS (others are left out)."""
    rows = labelled.where(F.col(label).isin(*LABELS)).select(F.coalesce(F.col(kind), F.lit("")).alias("kind"), F.col(label).alias("label"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    priors = {(r.kind, r.label): r.n for r in rows.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    hits = rows.select("kind", "label", F.explode(F.array_distinct(F.transform(words(F.col("text")), bucket))).alias("bucket")).groupBy("kind", "label", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = {kind: np.zeros((len(LABELS), BUCKETS)) for kind, _ in priors}
    for r in hits.toLocalIterator():
        counts[r.kind][LABELS.index(r.label), r.bucket] = r.n
    return {kind: WordWeights(np.array([priors.get((kind, x), 0) for x in LABELS], dtype=float), c) for kind, c in counts.items()}
