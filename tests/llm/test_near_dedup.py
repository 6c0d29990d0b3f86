"""Near duplicates against comparing all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from loadweave.llm import near_dedup, shards, stars
from tests.llm.frames import frame, odd_rows, prose
from tests.llm.test_jaccard import edited

BLANK = " \t\n\x0b\x0c\r"


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in BLANK[1:]:
        lower = lower.replace(c, " ")
    w = [x for x in lower.split(" ") if x]
    k = min(5, max(1, len(w)))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def expected(rows):
    """(n_shingles, component_id, kept) of each row, by brute force."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 85 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 85 * (len(x) + len(y) - both):
                    parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(root(k))
        out.append((i, len(sets[k]), c, c is None or i == c))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, near_dedup.near_dedup(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def groups(rnd, n_groups, n_most):
    rows = []
    for g in range(n_groups):
        text = prose(g, rnd.randint(30, 150))
        for k in range(rnd.randint(1, n_most)):
            rows.append((len(rows), text.upper() if k == 1 else text))
            text = edited(text, rnd, rnd.randint(1, 2))
    rnd.shuffle(rows)
    return rows


def test_copies_near_copies_and_chains(spark):
    rows = groups(random.Random(3), 25, 8)
    want = expected(rows)
    assert len({r[2] for r in want}) < len(rows) - 40
    assert got(frame(spark, rows)) == want


@pytest.mark.parametrize("most_edits", [1, 3])
def test_a_group_larger_than_a_bucket_may_be(spark, monkeypatch, most_edits):
    """With one edit all are joined with the leader, with three many are strays."""
    monkeypatch.setattr(near_dedup, "SMALL", 16)
    rnd = random.Random(5)
    text = prose(1, 90)
    rows = [(i, edited(text, rnd, rnd.randint(1, most_edits))) for i in range(160)] + [(500 + i, prose(900 + i, 30)) for i in range(20)]
    assert got(frame(spark, rows)) == expected(rows)


def test_odd_rows(spark):
    rows = [*odd_rows(), (20, "Ü ü Ü ü Ü ü"), (21, "ü ü ü ü ü ü"), (22, "a\x0bb\x0cc d e f"), (23, "A B C D E F"), (5, prose(1, 80)), (30, prose(8, 60)), (30, prose(9, 60)), (31, prose(9, 60)), (32, edited(prose(9, 60), random.Random(1), 1))]
    assert got(frame(spark, rows)) == expected(rows)


def test_no_rows(spark):
    assert got(frame(spark, [])) == []


def test_the_threshold_is_exact(spark):
    """17 of 20 shingles shared is 85 percent and linked, 16 of 19 less and not."""
    def doc(shared, own, tag):
        words = [f"s{i}" for i in range(shared + 4)]
        return " ".join(words + [f"{tag}{i}" for i in range(own)])

    rows = [(1, doc(17, 0, "")), (2, doc(17, 3, "x")), (3, "q " + doc(16, 0, "").replace("s", "t")), (4, doc(16, 3, "y").replace("s", "t"))]
    want = expected(rows)
    assert [r[2] for r in want] == [1, 1, 3, 4]
    assert got(frame(spark, rows)) == want


def test_minima_agree_as_often_as_sets_overlap():
    rnd = np.random.default_rng(1)
    shared, a, b = (rnd.integers(0, 1 << 63, n, dtype=np.uint64) for n in (850, 75, 75))
    x, y = (near_dedup.minima(np.unique(np.concatenate([shared, z]))) for z in (a, b))
    assert abs((x == y).mean() - 0.85) < near_dedup.SLACK


@pytest.mark.parametrize("few", [0, 50_000])
def test_stars_of_a_chain_a_star_and_a_ring(spark, monkeypatch, few):
    monkeypatch.setattr(stars, "FEW", few)
    monkeypatch.setattr(shards, "HOT_ROWS", 20)
    monkeypatch.setattr(shards, "MOST_HOT", 5)
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(80)] + [(400 + i, 400 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    links = [(b, a) if rnd.random() < 0.5 else (a, b) for a, b in links]
    got = {r["node"]: r["component"] for r in stars.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {200 + i: 100 for i in range(80)} | {400 + i: 400 for i in range(1, 9)}
    assert got == want
    assert stars.components(spark.createDataFrame([], "a long, b long")).count() == 0
