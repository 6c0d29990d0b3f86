"""Containment search against comparing all pairs."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from loadweave.llm import decontaminate
from tests.llm.frames import frame, odd_rows, prose


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def runs(text, n):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def expected(docs, items):
    out = set()
    for doc_id, text in docs:
        for item_id, item in items:
            n = min(5, max(1, len(re.findall(r"[^\W_]+", (item or "").lower()))))
            own, want = runs(text, n), runs(item, n)
            if doc_id is not None and item_id is not None and want and len(own & want) >= 0.8 * len(want):
                out.add((doc_id, item_id, len(own & want), len(want)))
    return sorted(out)


def got(spark, docs, items):
    items = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("hash", F.lit("x"))
    return sorted(tuple(r)[:4] for r in decontaminate.contained_items(frame(spark, docs), items).collect())


def case(smallest):
    rnd = random.Random(smallest)
    items = [(i, prose(i, rnd.randint(smallest, 70))) for i in range(30)]
    docs = []
    for i in range(120):
        parts = [prose(1000 + i, rnd.choice([3, 40, 900]))]
        for _ in range(rnd.randint(0, 2)):
            words = rnd.choice(items)[1].split()
            if rnd.random() < 0.5:
                words[rnd.randrange(len(words))] = "altered"
            parts.append(", ".join(words).upper())
        docs.append((i, "\n".join(parts)))
    return docs, items


def test_items_inside_documents(spark):
    for smallest in (14, 5):
        docs, items = case(smallest)
        want = expected(docs, items)
        assert len(want) > 30 and got(spark, docs, items) == want


def test_odd_rows(spark):
    items = [(1, None), (2, ""), (3, "four words are few"), (4, prose(1, 30)), (4, prose(1, 30)), (None, prose(1, 30)), (5, prose(99, 40))]
    docs = [r for r in odd_rows()]
    assert got(spark, docs, items) == expected(set(docs), set(items))


def test_items_of_few_words_are_sought_as_whole_runs(spark):
    items = [(1, "Lantern river"), (2, "stone"), (3, "quiet morning copper, silver"), (4, prose(3, 6)), (5, prose(4, 40)), (6, ""), (7, None), (8, "a b c d e")]
    docs = [(1, "the lantern river flows"), (2, "stone-cold"), (3, "Quiet Morning copper silver road"), (4, "quiet morning and copper silver"), (5, "x " + prose(3, 6)), (6, prose(4, 40)), (7, "lantern"), (8, "z a b c d e f"), (9, None)]
    want = expected(docs, items)
    assert {(1, 1), (2, 2), (3, 3), (5, 4), (6, 5), (8, 8)} <= {r[:2] for r in want}
    assert got(spark, docs, items) == want


def test_empty_tables(spark):
    assert got(spark, [], [(1, prose(1, 30))]) == [] and got(spark, [(1, prose(1, 30))], []) == []


def test_without_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SIDE_ROWS", 0)
    docs, items = case(14)
    assert got(spark, docs, items) == expected(docs, items)


def test_documents_with_an_item_go(spark):
    docs, items = case(14)
    left = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == frame(spark, docs).columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in docs} - {r[0] for r in expected(docs, items)}


def test_no_python_in_the_plan(spark):
    docs, items = case(14)
    plan = decontaminate.contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_bins_grow_as_items_shrink():
    assert decontaminate.bins_per_shingle(100) == 1
    assert decontaminate.bins_per_shingle(8) > 1
    assert decontaminate.bins_per_shingle(1) is None
