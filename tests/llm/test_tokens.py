import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from marketloom.llm.tokens import PrefixCounter, count_tokens  # noqa: E402

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["", " ", "a", "  a   b\n\n\nc \t d", "I'll they've we're 'r 'tis", "éèçñ ß 漢字 🙂🙂  x  y\x1c z\x85", "x<|endoftext|> y<|endoftext|>", "<|endof", "\u0000\u0001﻿", "a" * 300, "12345 67890.00!!!??", "-" * 200 + " end", "ab" * 700, "\r\n \r\n"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(PATH)


def texts():
    rng = random.Random(3)
    alphabet = "abcdefghijklmnopqrstuvwxyzTHE  ''.,!?\n\té漢ñ09"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(400)]


def test_whole_texts_count_as_the_library_counts(library, counter):
    cut = [counter.cut(t) for t in texts()]
    counter.learn()
    for text, parts in zip(texts(), cut):
        assert counter.total(parts) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_many_long_pieces_count_as_the_library_counts(library):
    rng = random.Random(5)
    own = PrefixCounter(PATH)
    long = ["".join(rng.choice("漢字言語処理日本東京大学生活") for _ in range(rng.randint(30, 200))) for _ in range(60)] + ["".join(rng.choice("abcde") for _ in range(900))]
    cut = [own.cut(t) for t in long]
    own.learn()
    assert [own.total(p) for p in cut] == [len(library.encode(t, add_special_tokens=False).ids) for t in long]


def test_every_offered_prefix_counts_exactly(library, counter):
    for text in texts()[:120]:
        lengths, counts = counter.prefixes(text)
        raw = text.encode()
        assert lengths[-1] == len(raw)
        for n, c in zip(lengths.tolist(), counts.tolist()):
            assert c == len(library.encode(raw[:n].decode(), add_special_tokens=False).ids), (text, n)


def test_query_rows_and_cuts(spark, library, counter):
    rows = [(i, t) for i, t in enumerate(texts())] + [(7, None), (None, "null id"), (3, ODD[3])]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens"), PATH, limit=9).collect()
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    by = {(r.doc_id, r.n_bytes): r for r in got}
    for i, t in rows:
        r, raw = by[i, len((t or "").encode())], (t or "").encode()
        assert r.over_limit == (r.n_tokens > 9)
        lengths, counts = counter.prefixes(t or "")
        assert r.cut_bytes == lengths[counts <= 9].max(), t
        assert len(library.encode(raw[: r.cut_bytes].decode(), add_special_tokens=False).ids) <= 9
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_unbroken_pieces_of_any_length_count_as_the_library_counts(library, monkeypatch):
    from marketloom.llm import tokens

    rng = random.Random(6)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    long = [letters, "a" * 30_001, "abc" * 9_000, "-" * 20_011, "".join(rng.choice("漢字言語処理日本東京") for _ in range(15_000)), "".join(rng.choice(["tion", "the", "ing", "an"]) for _ in range(9_000)), letters[:5000], letters[:4097], letters[:100]]
    for places in (1 << 19, 10_007):  # in one range, and over many
        monkeypatch.setattr(tokens, "PLACES", places)
        own = PrefixCounter(PATH)
        cut = [own.cut(t) for t in long]
        own.learn()
        assert [own.total(p) for p in cut] == [len(library.encode(t, add_special_tokens=False).ids) for t in long]
        for t in (letters, long[4]):  # every prefix, some of them held against the library
            lengths, counts = own.prefixes(t)
            raw = t.encode()
            for k in rng.sample(range(len(lengths)), 12):
                assert counts[k] == len(library.encode(raw[: lengths[k]].decode(), add_special_tokens=False).ids)


def test_twenty_megabytes_in_one_text(spark, library):
    block = " ".join("".join(random.Random(i).choice("etaoinshrdlu") for _ in range(1 + i % 9)) for i in range(3000)) + " "
    n = 20_000_000 // len(block)
    rows = [(1, block * n), (2, block)]
    got = {r.doc_id: r for r in count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert got[2].n_tokens == len(library.encode(block, add_special_tokens=False).ids) and got[1].n_bytes == n * len(block)
    two = len(library.encode(block * 2, add_special_tokens=False).ids)  # copies meet in the same pieces everywhere
    assert got[1].n_tokens == got[2].n_tokens + (n - 1) * (two - got[2].n_tokens)
