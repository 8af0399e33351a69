"""Language identification with bit-sliced Bloom filters.

One filter serves all languages: a slot holds a bit mask, bit l of it being language l's Bloom filter.  Hashing
a 4-byte gram to HASHES slots and AND-ing their masks gives, in one look-up, every language that contains the
gram.  A document's counts per language are corrected by each language's false-positive rate (its share
of set slots to the power HASHES); the largest corrected share decides.

Learning: at most SAMPLE_DOCS documents per language, chosen by a hash of the id, from rows with crc32(doc_id) mod 5
<> 0 and a language.  A language holds the grams that occur twice and make up at least MIN_SHARE of its grams.  The filter's
size is fixed (2^SLOT_BITS slots times one 64-bit word per 63 languages); all documents are predicted.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a text with letters but no gram
known to any language gets the language with most learned documents and score 0; of languages with equal shares the one with
more learned documents, then the first by name, is taken; texts over PIECE bytes are counted piece by piece; null ids count as
held out; without any language to learn all rows are ``und``; equal rows get equal results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import PIECE, mixed, slices
from .common import text_or_empty

SAMPLE_DOCS, MIN_SHARE, SLOT_BITS, HASHES, WORD_BITS = 2000, 2e-5, 20, 3, 63
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams with one blank at most of all texts, and the text that each is from, in parts of some PIECE bytes."""
    parts = [t.lower().encode() for t in texts]
    whole = b"    ".join([b"", *parts, b""])
    stops = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 4)
    for begin in range(0, max(1, len(whole) - 3), PIECE):
        data = np.frombuffer(whole[begin : begin + PIECE + 3].translate(_LETTERS), dtype=np.uint8)
        blank = (data == 32).view(np.int8)
        n = len(data) - 3
        keep = np.flatnonzero(blank[:n] + blank[1 : n + 1] + blank[2 : n + 2] + blank[3 : n + 3] <= 1)
        wide = data.astype(np.uint32)
        grams = (wide[:n] | wide[1 : n + 1] << np.uint32(8) | wide[2 : n + 2] << np.uint32(16) | wide[3 : n + 3] << np.uint32(24))[keep]
        yield grams, np.searchsorted(stops, begin + keep, side="right")


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    base = grams.astype(np.uint64) << np.uint64(8)
    return [mixed(base | np.uint64(j)) >> np.uint64(64 - SLOT_BITS) for j in range(HASHES)]


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """The languages, most documents first, and the filter: masks[word, slot]."""
    known = docs.select("doc_id", "lang", "text").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = [(r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    langs = [lang for lang, _ in sorted(counts, key=lambda x: (-x[1], x[0]))]
    if not langs:
        return [], np.zeros((1, 1 << SLOT_BITS), dtype=np.uint64)
    place = docs.sparkSession.createDataFrame([(lang, i, min(1.0, sample_docs / dict(counts)[lang])) for i, lang in enumerate(langs)], "lang string, no int, share double")
    drawn = (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) / 1_000_003) < F.col("share")
    sample = known.join(F.broadcast(place), "lang").where(drawn).select("no", "text")  # `place` has a row per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            numbers = np.asarray(batch.column("no")).astype(np.uint64)
            for grams, owner in _grams([t.decode() for t in texts]):
                codes, n = np.unique(numbers[owner] << np.uint64(32) | grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((codes >> np.uint64(32)).astype(np.int32)), pa.array((codes & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], names=["no", "gram", "n"])

    grams = sample.mapInArrow(run, "no int, gram long, n long").groupBy("no", "gram").agg(F.sum("n").alias("n"))
    totals = grams.groupBy("no").agg(F.sum("n").alias("total"))
    grams = grams.join(F.broadcast(totals), "no").where(F.col("n") >= F.greatest(F.lit(2), F.col("total") * MIN_SHARE)).select("no", "gram")  # a row per language

    def place_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no = np.asarray(batch.column("no")).astype(np.int64)
            slots = np.concatenate(_slots(np.asarray(batch.column("gram")).astype(np.uint32))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(no // WORD_BITS, HASHES)), pa.array(slots), pa.array(np.tile(np.int64(1) << no % WORD_BITS, HASHES))], names=["word", "slot", "bits"])

    set_bits = grams.mapInArrow(place_bits, "word long, slot long, bits long").groupBy("word", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    masks = np.zeros((-(-len(langs) // WORD_BITS), 1 << SLOT_BITS), dtype=np.uint64)
    masks[np.asarray(set_bits.column("word")), np.asarray(set_bits.column("slot"))] = np.asarray(set_bits.column("bits")).astype(np.uint64)
    return langs, masks


def predict(texts: list[str], langs: list[str], masks: np.ndarray, false_rate: np.ndarray) -> tuple[list[str], np.ndarray]:
    n = len(texts)
    total, found = np.zeros(n), np.zeros((len(langs), n))
    for grams, owner in _grams(texts):
        total += np.bincount(owner, minlength=n)
        slots = _slots(grams)
        for word in range(len(masks)):
            hits = masks[word][slots[0]]
            for s in slots[1:]:
                hits &= masks[word][s]
            for i in range(word * WORD_BITS, min(len(langs), (word + 1) * WORD_BITS)):
                found[i] += np.bincount(owner[(hits >> np.uint64(i % WORD_BITS) & np.uint64(1)).astype(bool)], minlength=n)
    rate = false_rate[:, None]
    share = np.maximum(0, found - total * rate) / np.maximum(total * (1 - rate), 1e-9)
    best, whole = share.argmax(axis=0), share.sum(axis=0)
    score = np.where(whole > 0, share[best, np.arange(n)] / np.maximum(whole, 1e-12), 0.0)
    lettered = np.fromiter((bool(_LETTER.search(t)) for t in texts), dtype=bool, count=n)
    return [langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())], np.where(lettered, np.clip(score, 0, 1), 0.0)


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    langs, masks = learn(docs, sample_docs)
    rate = np.array([((masks[i // WORD_BITS] >> np.uint64(i % WORD_BITS)) & np.uint64(1)).mean() ** HASHES for i in range(len(langs))])
    held = docs.sparkSession.sparkContext.broadcast((langs, masks, rate))  # fixed size: 8 MB for up to 63 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, false_rate = held.value
        for batch, texts in slices(batches):
            pred, score = predict([t.decode() for t in texts], names, table, false_rate) if names else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), text_or_empty().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
