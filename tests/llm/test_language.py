"""Language identification: sums over segmentations, learning, defined cases."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
import regex

from loadweave.llm import language, queries, sampling
from tests.llm.frames import by_id, frame, odd_rows, prose

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pieces():
    return language.Pieces(PATH)


def by_enumeration(names, chances, word, stray):
    """P(word) by going through all segmentations."""
    index = {n: i for i, n in enumerate(names)}
    word = "▁" + word
    total = [0.0] * len(word) + [1.0]
    for i in range(len(word) - 1, -1, -1):
        for j in range(i + 1, len(word) + 1):
            p = index.get(word[i:j])
            if p is not None:
                total[i] += chances[p] * total[j]
            elif j == i + 1:
                total[i] += stray * total[j]
    return total[0]


def test_forward_sums_all_segmentations(pieces):
    rng = np.random.default_rng(1)
    chances = np.vstack([rng.dirichlet(np.ones(len(pieces.names)), 2).T, np.full(2, language.STRAY)])
    words = ["the", "a", "haus", "garçon", "ñandú", "字漢", "x" * 48, "éclair"]
    got = pieces.log_chances(words, chances)
    for i, w in enumerate(words):
        for k in range(2):
            assert got[i, k] == pytest.approx(np.log(by_enumeration(pieces.names, chances[:, k], w, language.STRAY)), rel=1e-9)


def test_expected_counts_are_those_of_the_gradient(pieces):
    """The expected uses of a piece are the derivative of the log-likelihood by its log-probability."""
    rng = np.random.default_rng(2)
    chances = np.vstack([rng.dirichlet(np.ones(len(pieces.names)))[:, None], [[language.STRAY]]])
    words, counts = ["there", "under"], np.array([3.0, 2.0])
    got = pieces.expected(words, counts, chances)
    for piece in np.argsort(-got)[:5]:
        up = chances.copy()
        up[piece] *= 1 + 1e-6
        change = (counts @ (pieces.log_chances(words, up) - pieces.log_chances(words, chances)))[0] / 1e-6
        assert got[piece] == pytest.approx(change, rel=1e-3)


def test_held_out_accuracy(spark):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op8_language(spark, SF).collect()
    assert len(rows) == len(langs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.98


def test_languages_of_held_out_documents_are_not_learned(spark):
    rows = [(i, "the and of river" if i % 2 else "der die und fluss", ("en" if i % 2 else "de") if zlib.crc32(str(i).encode()) % 5 else "xx") for i in range(40)]
    out = by_id(language.language(frame(spark, rows), PATH), "lang_pred")
    assert {v[0][0] for v in out.values()} == {"en", "de"}


def test_odd_rows(spark):
    learn = [(100 + i, "the river and the stone", "en") for i in range(10)] + [(200 + i, None, "fr") for i in range(5)] + [(300 + i, "12 34", "en") for i in range(5)] + [(400 + i, "text", None) for i in range(5)]
    rows = [(*r, None) for r in odd_rows()] + learn
    out = by_id(language.language(frame(spark, rows), PATH), "lang_pred", "score")
    assert sum(map(len, out.values())) == len(rows)
    assert all(out[i] == [("und", 0.0)] for i in (1, 2, 3, 12, 200, 300))
    assert out[8][0][0] == "en" and out[4][0][0] == "en"


def test_nothing_to_learn_from(spark):
    out = by_id(language.language(frame(spark, [(1, "some text", None)]), PATH), "lang_pred", "score")
    assert out == {1: [("und", 0.0)]}
    assert language.language(frame(spark, []), PATH).count() == 0


def test_rare_language_beside_a_large_one(spark):
    """The sample is bounded for each language, so a language with a few documents is learned however many others there are."""
    rows = [(i, "the river and the stone under the bridge", "en") for i in range(2_000)] + [(5_000 + i, "der fluss und die brücke", "de") for i in range(4)]
    assert any(zlib.crc32(str(i).encode()) % 5 for i in range(5_000, 5_004))
    rows += [(6_000 + i, "12 34", "fr") for i in range(100)] + [(7_000 + i, "les pierres de la rivière", "fr") for i in range(4)]
    docs = frame(spark, rows)
    assert language.fit(docs, PATH, 10)[0] == ["de", "en", "fr"]
    out = by_id(language.language(docs, PATH, 10), "lang_pred")
    assert all(out[i] == [("de",)] for i in range(5_000, 5_004)) and all(out[i] == [("fr",)] for i in range(7_000, 7_004)) and out[0] == [("en",)]


def test_sample_of_each_is_bounded(spark):
    rows = spark.createDataFrame([(i, "a" if i % 100 else "b") for i in range(5_000)], "doc_id long, lang string")
    for n, expected in [(1, {"a": 1, "b": 1}), (60, {"a": 60, "b": 50})]:
        assert {r["lang"]: r["count"] for r in sampling.sample_of_each(rows, "lang", n).groupBy("lang").count().collect()} == expected


def test_number_signs_are_no_letters_and_marks_belong_to_words(spark, pieces):
    assert language.words_of("Über हिन्दी x1y ½ e\u0301t") == ["über", "हिन्दी", "x", "y", "e\u0301t"]
    rows = [(5 * i + k, prose(k + 10 * i, 30), ("en", "de")[k % 2]) for i in range(10) for k in range(5)]
    docs = frame(spark, rows + [(1001, "½", None), (1002, "² ³", None), (1003, "①② Ⅷ", None), (1004, "\u0301", None), (1005, "é", None)])
    out = {r["doc_id"]: r["lang_pred"] for r in language.language(docs, PATH).collect()}
    assert [out[i] for i in (1001, 1002, 1003, 1004)] == ["und"] * 4 and out[1005] in ("en", "de")


def test_hits_are_plain_numbers_and_words_are_cut_as_by_letters_with_their_marks(pieces):
    """No Python object is made for a hit, and one class of characters gives the words of letters followed by marks."""
    assert all(isinstance(hit, int) for _, hit in pieces.automaton.iter("▁the\n▁river"))
    word, start, stop, piece, sizes = pieces.lattice(["the", "ñ🜁"])
    names = [pieces.names[p] if p >= 0 else None for p in piece]
    assert all(n is None or n == ("▁the", "▁ñ🜁")[w][a:b] for n, w, a, b in zip(names, word, start, stop))
    old = regex.compile(r"(?:\p{L}\p{M}*)+")
    text = "".join(chr(c) + "\u0301a" * (c % 3) + ("1", " ", "\u0301", "")[c % 4] for c in range(0x3000))
    assert [w for x in old.findall(text.lower()) for w in (x[i : i + 48] for i in range(0, len(x), 48))] == language.words_of(text)
