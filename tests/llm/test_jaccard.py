"""The similarity join against comparing all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from loadweave.llm import cells, jaccard
from loadweave.llm.components import components
from tests.llm.frames import frame, odd_rows, prose


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    k = min(5, max(1, len(w)))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def expected(rows):
    """{doc_id: (class_id, n_links)} for distinct ids."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links, parent = Counter(), {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)):
                both = len(x & y)
                if both >= 0.8 * (len(x) + len(y) - both) - 1e-6:
                    links[i] += 1
                    links[j] += 1
                    p, q = sorted((root(i), root(j)))
                    parent[q] = p
    return {i: (root(i), links[i]) for i, _ in sets}


def got(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(df).collect()}


def edited(text, rnd, n):
    words = text.split()
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"changed{rnd.randrange(10**6)}"
    return " ".join(words)


def test_copies_near_copies_and_chains(spark):
    rnd = random.Random(2)
    rows = []
    for g in range(25):
        text = prose(g, 120)
        for k in range(rnd.randint(1, 6)):
            rows.append((len(rows), text.upper() if k == 1 else text))
            text = edited(text, rnd, rnd.randint(1, 3))
    common = prose(77, 40)
    rows += [(1000 + i, f"{common} {prose(500 + i, rnd.randint(4, 60))}") for i in range(60)]
    rnd.shuffle(rows)
    assert got(frame(spark, rows)) == expected(rows)


def test_a_group_larger_than_a_bucket_may_be(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 40)
    rnd = random.Random(4)
    text = prose(1, 150)
    rows = [(i, edited(text, rnd, rnd.randint(1, 3))) for i in range(150)] + [(500 + i, prose(900 + i, 30)) for i in range(30)]
    want = expected(rows)
    assert max(n for _, n in want.values()) > 60
    assert got(frame(spark, rows)) == want


def test_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] not in (7, None)] + [(7, prose(1, 80))]
    assert got(frame(spark, rows)) == expected(rows)
    out = jaccard.jaccard_join(frame(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows())
    assert all(r["class_id"] is None and r["n_links"] == 0 for r in out if r["doc_id"] is None)
    # the repeated row is a document of its own
    assert [r["n_links"] for r in out if r["doc_id"] == 7] == [2, 2]


def test_no_rows(spark):
    assert got(frame(spark, [])) == {}


def test_lower_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        jaccard.jaccard_join(frame(spark, []), 0.5)


def test_chance_falls_with_depth_and_runs_make_up_for_it():
    q = [jaccard.together(d) for d in range(1, 8)]
    assert q == sorted(q, reverse=True) and q[0] > 0.8 and q[-1] > 0.4


def test_tokens_agree_as_often_as_sets_overlap():
    rnd = np.random.default_rng(1)
    shared, a, b = (rnd.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = (jaccard.tokens(np.unique(np.concatenate([shared, z]))) for z in (a, b))
    assert abs((x == y).mean() - 0.8) < jaccard.SLACK


def test_intersections_by_matrix():
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, 9_000, rnd.integers(1, 6_000), dtype=np.uint64)) for _ in range(9)]
    both = cells.intersections(sets)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if i != j:
                assert both[i, j] == len(np.intersect1d(x, y))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 200 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[200 + i] == 100 for i in range(50)) and len(got) == 92


def test_texts_that_share_an_id_do_not_take_their_copies_along(spark):
    rnd = random.Random(9)
    a, b = prose(1, 80), prose(2, 80)
    near = edited(b, rnd, 1)
    rows = [(5, a), (5, b), (77, b), (78, b), (79, near), (80, edited(a, rnd, 1))]
    out = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(frame(spark, rows)).collect())
    assert out == [(5, 5, 1), (5, 5, 3), (77, 5, 3), (78, 5, 3), (79, 5, 3), (80, 5, 1)]


def test_splitting_shuffles_no_tokens(spark, monkeypatch):
    """Large buckets go to the classes; the classes and their tokens do not go to the buckets."""
    monkeypatch.setattr(jaccard, "SMALL", 40)
    rnd = random.Random(6)
    common = prose(3, 60)
    docs = frame(spark, [(i, f"{common} {prose(100 + i, rnd.randint(10, 60))}") for i in range(120)])
    seen = jaccard.stored(jaccard.sketched(docs).withColumnRenamed("print", "rep"))
    plans, stored = [], jaccard.stored

    def kept(df):
        plans.append(df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return stored(df)

    monkeypatch.setattr(jaccard, "stored", kept)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, depth = jaccard._buckets(seen, 0, 2)
        assert depth > 1 and rows.columns == ["rep", "node", "n"]
        sizes = {r["node"]: (r["n"], r["count"]) for r in rows.groupBy("node", "n").count().collect()}
        assert sizes and all(n == count > 1 for n, count in sizes.values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    shuffled = [m for p in plans for m in re.findall(r"\) Exchange.*\nInput \[\d+\]: (.*)", p)]
    assert shuffled and not [m for m in shuffled if "tokens" in m]
