"""Exact deduplication against grouping in Python."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import corpus_pipeline
import numpy as np

from loadweave.llm import exact_dedup
from tests.llm.frames import frame, odd_rows, prose


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normal(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i is not None and i == keep, digest) for i in ids]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, exact_dedup.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_odd_rows(spark):
    assert got(frame(spark, odd_rows())) == expected(odd_rows())


def test_only_ascii_letters_fold(spark):
    rows = [(1, "ÄB"), (2, "äb"), (3, "Äb"), (4, "K"), (5, "K"), (6, "k")]
    assert got(frame(spark, rows)) == expected(rows)


def test_a_group_of_a_third_of_all_rows(spark):
    rows = [(i, "Same TEXT" if i % 3 == 0 else prose(i % 50, 6)) for i in range(900)]
    assert got(frame(spark, rows)) == expected(rows)


def test_no_rows(spark):
    assert got(frame(spark, [])) == []


def test_more_batches_give_the_same(spark):
    rows = [(i, prose(i % 40, 5)) for i in range(200)]
    out = exact_dedup.exact_dedup(frame(spark, rows), batches=3)
    assert sorted(map(tuple, out.collect()), key=repr) == expected(rows)


def test_texts_of_equal_digests_are_told_apart_by_their_bytes(spark):
    """Two snapshots with one digest for two texts: the byte check keeps them apart."""
    docs = frame(spark, [(1, "one"), (2, "two")])
    store = exact_dedup.Snapshots(docs)
    first = store.add(spark.createDataFrame([(1, "ab" * 32)], "doc_id long, text_sha256 string"))
    second = store.add(spark.createDataFrame([(2, "ab" * 32)], "doc_id long, text_sha256 string"))
    assert [r["class_key"] for r in first.collect()] == ["1"] and [r["class_key"] for r in second.collect()] == ["2"]


def test_filters_hold_all_members_and_few_others():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 100, 5_000, 60_000):
        keys = rng.integers(0, 1 << 60, n, dtype=np.uint64)
        made = exact_dedup.BinaryFuse.build(keys)
        assert made.passes(keys).all()
        assert len(made.cells) <= max(256, 1.6 * n)
        others = rng.integers(1 << 60, 1 << 61, 50_000, dtype=np.uint64)
        assert made.passes(others).mean() < 0.001


def test_an_id_that_is_the_largest_of_two_texts(spark):
    rows = [(1, "one"), (50, "one"), (2, "two"), (50, "two"), *[(60 + i, "one") for i in range(6)]]
    out = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("one", "two")}
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out if r["text_sha256"] == digest["two"]) == [(2, 50, 2, False), (50, 50, 2, True)]
    assert {(r["keep_id"], r["group_size"]) for r in out if r["text_sha256"] == digest["one"]} == {(65, 8)}
    left = corpus_pipeline.distinct_texts(spark, frame(spark, rows), "")
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(50, "two"), (65, "one")]


def test_two_texts_of_one_id_are_two_classes(spark):
    out = exact_dedup.exact_dedup(frame(spark, [(50, "one"), (50, "two")])).collect()
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in out] == [(50, 1, True)] * 2
