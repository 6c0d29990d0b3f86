"""The filter audit against applying all orders to every document, and its matrix against counting words."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from loadweave.llm import filter_audit as fa, shards
from tests.llm.frames import frame, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, labels):
    marks = {}
    for i, q, t in labels:
        if i is not None:
            g, x = marks.get(i, (0, 0))
            marks[i] = (max(g, int(q == 1)), max(x, int(t == 1)))
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, *part in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i,
        }
        docs.append(((part[0] or "") if part else "en", {f for f, bad in fails.items() if bad}, *marks.get(i, (0, 0))))
    out, removed = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left = [d for d in left if f not in d[1]]
                unique = sum(d[0] == part and d[1] == {f} for d in docs)
                out[part, "".join(order), step] = [len(left), len(here), redundant, unique, sum(d[2] for d in here), sum(d[3] for d in here)]
                removed[part, f] += len(here)
                gone += here
    return sorted((*k, *v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items())


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def got(docs, labels):
    return sorted(map(tuple, fa.filter_audit(docs, labels).select(COLUMNS).collect()))


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def mixed_rows():
    rnd = random.Random(2)
    rows = []
    for i in range(120):
        t = prose(i % 90, rnd.choice([20, 99, 100, 101, 160]))
        if i % 3 == 0:
            t = " ".join(f"{w}{k}" for k, w in enumerate(t.split()))
        if i % 5 == 0:
            t = t.upper()
        if i % 7 == 0:
            t += rnd.choice("#$%&*|")
        rows.append((i, t, rnd.choice(["en", "de", None, ""])))
    return rows


def test_against_all_orders(spark):
    rows = mixed_rows()
    labels = [(i, i % 2, int(i % 11 == 0)) for i in range(0, 120, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (5, None, None)]
    assert got(frame(spark, rows), labelled(spark, labels)) == expected(rows, labels)


def test_odd_rows(spark):
    rows = [(*r, "en") for r in odd_rows()] + [(40, "ÀÉ Straße 1 2 3", "fr"), (41, "a\x1cb c d", None), (3, None, "fr")]
    assert got(frame(spark, rows), labelled(spark, [(1, 1, 1)])) == expected(rows, [(1, 1, 1)])


def test_limits_are_exact(spark):
    """100 words, 80 of 100 distinct, and one capital in ten characters pass."""
    words = [f"w{k}" for k in range(80)]
    rows = [(1, " ".join(words + words[:20]), "a"), (2, " ".join(words[:79] + words[:21]), "b"), (3, "A" + "b" * 9, "c"), (4, "A" + "b" * 8, "d")]
    fails = {r["doc_id"]: r["fails"] for r in fa.failures(frame(spark, rows)).collect()}
    assert fails == {1: 0, 2: 2, 3: 1, 4: 5}
    assert got(frame(spark, rows), labelled(spark, [])) == expected(rows, [])


def test_no_rows(spark):
    assert got(frame(spark, []), labelled(spark, [])) == []


@pytest.mark.parametrize("bucket_keys", [40, 1 << 16])
def test_matrix_and_dictionary(spark, monkeypatch, bucket_keys):
    monkeypatch.setattr(shards, "BUCKET_KEYS", bucket_keys)
    monkeypatch.setattr(shards, "LEAST_PIECE", 4)
    rows = mixed_rows()
    matrix, words = fa.document_term_matrix(frame(spark, rows))
    names = {r["id"]: r["key"] for r in words.collect()}
    assert len(names) == words.count() == len(set(names.values()))
    assert bucket_keys == 40 or sorted(names) == list(range(len(names)))
    found = matrix.collect()
    assert len(found) > 5 and len({r["shard"] for r in found}) == len(found)
    counts = {}
    for r in found:
        indptr, indices, data = (np.frombuffer(r[c], t) for c, t in (("indptr", np.int64), ("indices", np.int64), ("counts", np.int32)))
        for k, doc in enumerate(r["doc_ids"]):
            at = slice(indptr[k], indptr[k + 1])
            counts[doc] = {names[i]: int(n) for i, n in zip(indices[at], data[at])}
    assert counts == {i: dict(Counter(t.split())) for i, t, _ in rows}


def test_shards_are_cut_by_size():
    sizes = [1, 2, shards.SHARD_BYTES, 5, shards.SHARD_BYTES // 2, shards.SHARD_BYTES // 2, 7]
    assert list(shards.cut(sizes)) == [slice(0, 3), slice(3, 6), slice(6, 7)] and list(shards.cut([])) == []


@pytest.mark.parametrize("parts", [1, 7])
def test_hot_keys_are_joined_like_the_others(spark, monkeypatch, parts):
    monkeypatch.setattr(shards, "HOT_ROWS", 5)
    monkeypatch.setattr(shards, "MOST_HOT", 3)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 10}") for i in range(60)] + [(99, None), (98, "none")], "i long, key string").repartition(parts)
    facts = rows.where("key <> 'none'").groupBy("key").agg({"*": "count", "i": "min"}).toDF("key", "n", "first")
    first = {r["key"]: r["first"] for r in facts.collect()}
    out = {r["i"]: r["first"] for r in shards.join_counted(rows, facts, "key").collect()}
    assert out == {r["i"]: first.get(r["key"]) for r in rows.collect()}
