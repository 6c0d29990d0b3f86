"""The quality classifier: features, learning, held-out labels."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from loadweave.llm import quality, queries
from tests.llm.frames import by_id, frame, odd_rows

SF = "/root/testdata/sf0.01"


def auc(y, s):
    y, s = np.array(y), np.array(s)
    return (s[y == 1][:, None] > s[y == 0][None, :]).mean()


def test_features_are_of_unit_length_and_do_not_depend_on_portions(monkeypatch):
    text = "The the THE!! 12 a | b c_d Ünï. " * 20
    slots, x = quality.features(text)
    assert np.isclose((x * x).sum(), 1)
    monkeypatch.setattr(quality, "PORTION", 7)
    again = quality.features(text)
    assert (again[0] == slots).all() and np.allclose(again[1], x)
    assert len(quality.features("")[0]) == 0 and len(quality.features(" \n")[0]) == 0


def test_training_parts_two_kinds_of_text():
    rows = [(*quality.features("good words here" if y else "BAD!! WORDS!!"), float(y)) for y in (0, 1) * 30]
    w, bias = quality.train(rows, 600)
    for slots, x, y in rows[:2]:
        assert (w[slots] @ x + bias > 0) == bool(y)


def test_held_out_ranking(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op9_quality(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc([labels[r["doc_id"]] for r in held], [r["score"] for r in held]) > 0.97


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def test_labels_of_held_out_documents_are_not_learned(spark):
    docs = frame(spark, [(i, "good words here and there" if i % 2 else "BAD!! WORDS!!") for i in range(80)])
    truth = [(i, i % 2, 0) for i in range(80)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in truth]
    one, two = (by_id(quality.quality(docs, labels_of(spark, rows)), "score") for rows in (truth, turned))
    assert one == two


def test_odd_rows(spark):
    rows = odd_rows()
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(12)] + [(6, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 0), (77, 1, 0)])
    out = by_id(quality.quality(frame(spark, rows), labels), "held_out", "score", "predicted")
    assert sum(map(len, out.values())) == len(rows)
    assert out[1][0][1] == out[2][0][1] == out[3][0][1]
    assert all(r[0] for r in out[None])


def test_no_labels_and_no_rows(spark):
    none = labels_of(spark, [])
    assert by_id(quality.quality(frame(spark, [(1, "text")]), none), "score", "predicted") == {1: [(0.5, 1)]}
    assert quality.quality(frame(spark, []), none).count() == 0


def test_the_sample_is_bounded(spark):
    docs = frame(spark, [(i, "good words here" if i % 2 else "BAD!! WORDS!!") for i in range(60)])
    out = by_id(quality.quality(docs, labels_of(spark, [(i, i % 2, 0) for i in range(60)]), max_rows=20), "predicted")
    assert len(out) == 60
