"""Passage removal against all windows in Python."""

from __future__ import annotations

import random

from loadweave.llm import substring_dedup
from tests.llm.frames import by_id, frame, odd_rows, prose

WINDOW = 20


def expected(rows):
    words = {}
    for doc_id, text in rows:
        words[doc_id, text] = (text or "").encode().split()
    first = {}
    for (doc_id, _), w in sorted((x for x in words.items() if x[0][0] is not None), key=lambda x: x[0][0]):
        for p in range(len(w) - WINDOW + 1):
            k = tuple(w[p : p + WINDOW])
            first[k] = min(first.get(k, (doc_id, p)), (doc_id, p))
    out = []
    for doc_id, text in rows:
        w = words[doc_id, text]
        lost = set()
        for p in range(len(w) - WINDOW + 1) if doc_id is not None else ():
            if first[tuple(w[p : p + WINDOW])] != (doc_id, p):
                lost.update(range(p, p + WINDOW))
        out.append((doc_id, len(w), len(lost), b" ".join(x for i, x in enumerate(w) if i not in lost)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r[0], r[1], r[2], bytes(r[3])) for r in substring_dedup.substring_dedup(df).collect()), key=repr)


def test_shared_passages(spark):
    rnd = random.Random(5)
    passages = [prose(i, rnd.randint(18, 60)) for i in range(15)]
    rows = [(i, " ".join(rnd.choice([prose(1000 + 7 * i + j, rnd.randint(1, 30)), rnd.choice(passages)]) for j in range(rnd.randint(0, 8)))) for i in range(120)]
    assert got(frame(spark, rows)) == expected(rows)


def test_few_words_repeat_inside_a_document(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 90)))) for i in range(40)]
    assert got(frame(spark, rows)) == expected(rows)


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 2_000)
    rnd = random.Random(7)
    common = prose(1, 55)
    rows = [(i, f"{prose(50 + i, 30)}\t{common if i % 3 else ''}\n{prose(rnd.randint(0, 5), 25)}") for i in range(60)]
    assert got(frame(spark, rows)) == expected(rows)


def test_odd_rows(spark):
    assert got(frame(spark, odd_rows())) == expected(odd_rows())


def test_only_ascii_blanks_part_words(spark):
    rows = [(1, "\x0b".join("abcdefghijklmnopqrst")), (2, "\x0c ".join("abcdefghijklmnopqrst")), (3, "\xa0".join("abcdefghijklmnopqrst")), (4, "\x1c".join("abcdefghijklmnopqrst"))]
    assert got(frame(spark, rows)) == expected(rows)
    assert {r[0]: r[2] for r in got(frame(spark, rows))} == {1: 0, 2: 20, 3: 0, 4: 0}


def test_no_rows(spark):
    assert got(frame(spark, [])) == []


def test_repeated_id_with_another_shorter_text(spark):
    passage, tail, short = prose(201, 30), prose(202, 40), prose(203, 25)
    rows = [(1, passage), (2, f"{tail} {passage}"), (2, short), (3, short), (4, passage), (4, tail)]
    out = by_id(substring_dedup.substring_dedup(frame(spark, rows)), "n_words", "n_removed", "kept")
    assert sorted(out[2]) == [(25, 0, short.encode()), (70, 30, tail.encode())]
    assert out[1] == [(30, 0, passage.encode())] and out[3] == [(25, 25, b"")]
    assert sorted(out[4]) == [(30, 30, b""), (40, 40, b"")]
