"""BPE coding against the tokenizers library."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from loadweave.llm import bpe, queries
from tests.conftest import SF
from tests.llm.frames import by_id, frame, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(PATH)


def ids(own, text):
    return np.frombuffer(next(iter(own.encode([text]))), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinorst'lv ABCÉéΣςßİ中字😀‍\x1c\x85\xa0\n\t.,!?012<|>_-²Ⅷ"), max_size=60))
def test_any_text_as_the_library(own, library, text):
    assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>a<|startoftext|>", "a<|endoftext|", "it's we'll I'm", "a" * 3000, "ab" * 2000, "!?" * 400, "naïve Ünï", "ΑΣ ΣΑΣ"])
def test_edges_as_the_library(own, library, text):
    got = ids(own, text)
    assert got == library.encode(text, add_special_tokens=False).ids
    assert own.decode(struct.pack(f"<{len(got)}I", *got)).decode() == library.decode(got, skip_special_tokens=False)


def test_every_token_yields_itself(own):
    assert own.sound.all()


def test_neighbours_that_merge_are_not_apart(own):
    th, e = own.vocab["th"], own.vocab["e</w>"]
    assert not own.apart(np.array([th]), np.array([e]))[0]
    assert own.merged("the") == [own.vocab["the</w>"]]


def test_short_and_long_merging_agree(own):
    for word in ("theonhaonanwh", "ndtiontionble", "aaaaaaaaaaaaaa", "abababababab"):
        start = [own.vocab[c] for c in word[:-1]] + [own.vocab[word[-1] + "</w>"]]
        assert own._merged_short(list(start)) == own._merged_long(list(start))


def test_memory_of_words_may_overflow(own, monkeypatch, library):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 50)
    monkeypatch.setattr(bpe, "PORTION", 40)
    small = bpe.Bpe(PATH)
    texts = [f"word{i} thing{i} <|endoftext|> other" for i in range(60)]
    got = [np.frombuffer(x, "<u4").tolist() for x in small.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_rows(spark, library):
    rows = odd_rows()
    out = by_id(bpe.decode(bpe.encode(frame(spark, rows), PATH), PATH), "ids", "decoded")
    assert sum(map(len, out.values())) == len(rows)
    for doc_id, text in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert (struct.pack(f"<{len(want)}I", *want), library.decode(want, skip_special_tokens=False)) in out[doc_id]


def test_no_rows(spark):
    assert bpe.encode(frame(spark, []), PATH).count() == 0


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op1_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
