"""Token alignment against comparing the byte ranges of all tokens."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loadweave.llm import token_alignment as ta
from tests.llm.frames import frame, odd_rows, prose

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def ranges(lengths):
    at, out = 0, []
    for n in lengths:
        out.append((at, at + n))
        at += n
    return out


def token_bytes(both, text):
    """[(id, bytes)] of A and of B by the libraries alone."""
    a, b = both
    coded = a.encode(" " + text, add_special_tokens=False)
    letter = {v: k for k, v in ta._byte_letters().items()}
    left = [(i, bytes(letter[c] for c in t)) for i, t in zip(coded.ids, coded.tokens)]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return left, right


def expected(both, rows):
    docs, counts = [], Counter()
    for doc_id, text in rows:
        left, right = token_bytes(both, text) if text else ([], [])
        raw = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
            docs.append((doc_id, [], [], [], []))
            continue
        ra, rb = ranges(len(x) for _, x in left), ranges(len(x) for _, x in right)
        links = [(left[i][0], right[j][0]) for i, (s, e) in enumerate(ra) for j, (u, v) in enumerate(rb) if s < v and u < e]
        counts.update(links)
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, last = [], 0
        for c in cuts:
            groups.append(",".join(str(left[i][0]) for i, (s, e) in enumerate(ra) if last < e <= c) + "|" + ",".join(str(right[j][0]) for j, (s, e) in enumerate(rb) if last < e <= c))
            last = c
        docs.append((doc_id, left, right, groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        (
            (
                d, len(left), len(right), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                sha256(";".join(groups).encode()).hexdigest() if links else "",
            )
            for d, left, right, groups, links in docs
        ),
        key=repr,
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    return sorted(map(tuple, ta.align_documents(df, PATH_A, PATH_B).select(COLUMNS).collect()), key=repr)


TEXTS = [
    "Hello world, it's 2024!", "a  b   c ", " leading", "tab\tnew\nline\r\n", "<s> and </s> <unk> <|endoftext|>", "naïve café ÀÉ ﬁ", "中文 日本語 한국어 😀👍🏽", "\x00\x01 zero",
    "under▁score", "é combining", "<0x41> literal", "x" * 500, "1234567890 " * 20, " nbsp em", "don't can't we'll I'd", "   ", "\n",
]


def test_against_all_ranges(spark, both):
    rows = [(i, t) for i, t in enumerate(TEXTS + [prose(k, 40) for k in range(15)])] + [(None, "Hello world"), (3, "Hello world"), (90, None), (91, "")]
    assert got(frame(spark, rows)) == expected(both, rows)


def test_odd_rows(spark, both):
    rows = [r for r in odd_rows() if r[0] not in (8, 9)] + [(8, prose(99, 400))]
    assert got(frame(spark, rows)) == expected(both, rows)
    long = [r for r in odd_rows() if r[0] in (8, 9)]
    assert {r[0]: r[1] > 30_000 for r in got(frame(spark, long))} == {8: True, 9: True}


def test_no_rows(spark):
    assert got(frame(spark, [])) == []


def test_alignment_of_random_cuts():
    rnd = random.Random(1)
    for _ in range(2000):
        n = rnd.randint(1, 40)
        p = rnd.random()
        a = [x for x in range(1, n) if rnd.random() < p] + [n]
        b = a if rnd.random() < 0.2 else [x for x in range(1, n) if rnd.random() < p] + [n]
        if rnd.random() < 0.3:
            b = sorted(set(a) - {rnd.choice(a)} | {n})
        groups, links = ta.align(a, b)
        ra, rb = ranges(np.diff([0, *a])), ranges(np.diff([0, *b]))
        want = sorted(i << 32 | j for i, (s, e) in enumerate(ra) for j, (u, v) in enumerate(rb) if s < v and u < e)
        assert sorted(ta.linked_pairs(groups, links, np.arange(len(a)), np.arange(len(b))).tolist()) == want
        text = ta.groups_text(groups, [*map(str, range(len(a)))], [*map(str, range(len(b)))])
        assert [a[int(g.split("|")[0].split(",")[-1])] for g in text.split(";")] == sorted(set(a) & set(b))


def test_runs_are_jumped_not_walked():
    class Ends(list):
        slices = 0

        def __getitem__(self, at):
            Ends.slices += isinstance(at, slice)
            return super().__getitem__(at)

    n = 100_000
    a = list(range(2, 2 * n, 2))
    b = sorted(set(a) - {a[n // 3]} | {a[n // 2] + 1})
    groups, _ = ta.align(Ends(a), Ends(b))
    assert len(groups) == 2 and Ends.slices < 300


def test_the_ranked_encoder_equals_the_library(both):
    coders = ta.tokenizers(PATH_A, PATH_B)
    assert coders.ranked is not None
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 20_000):
        text = [f" a{chr(c)}{chr(c)}b 1{chr(c)}2 .{chr(c)}! {chr(c)}  {chr(c)}x" for c in points[i : i + 20_000 : 7]]
        assert coders.encode_a(text) == [e.ids for e in both[0].encode_batch_fast(text, add_special_tokens=False)]


def test_words_encoded_apart_are_those_of_the_whole_text(monkeypatch):
    coders = ta.tokenizers(PATH_A, PATH_B)
    assert coders.apart
    rnd = random.Random(3)
    parts = ["a", "the", "Haus", "  ", " ", "   ", "\n", "\t", "é", "中文", "\x00", "▁", "1", "...", "<s>", "</s>", "<0x41>", "😀", " ", "ﬁ", "é", "x" * 500, "don't", " "]
    texts = ["".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 30))) for _ in range(4_000)] + [" ", "  ", "a ", "a  ", " a", "  a"]
    monkeypatch.setattr(ta, "WORDS_KEPT", 500)
    for i in range(0, len(texts), 100):
        assert [x.tolist() for x in coders.encode_b(texts[i : i + 100])] == coders.b.encode(texts[i : i + 100])
    assert 0 < len(coders.known_b)


def test_words_are_encoded_once():
    coders = ta.Tokenizers(PATH_A, PATH_B)
    sent, model = [], coders.b

    class Counted:
        def encode(self, texts, **more):
            sent.extend([texts] if isinstance(texts, str) else texts)
            return model.encode(texts, **more)

    coders.b = Counted()
    texts = ["the river and the stone"] * 50
    first, second = ([(a.tolist(), b.tolist()) for a, b in coders.encode(texts)] for _ in range(2))
    assert first == second and sorted(sent) == ["and", "river", "stone", "the"]
