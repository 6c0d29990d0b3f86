"""The pipeline against its stages worked out in Python, and the queries against SQL."""

from __future__ import annotations

import os
from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loadweave.llm import exact_dedup, quality
from loadweave.llm.oracle import ORACLE
from loadweave.llm.queries import QUERIES
from tests.conftest import SF
from tests.llm.frames import frame, odd_rows, prose
from tests.llm.test_decontaminate import expected as leaks
from tests.llm.test_exact_dedup import normal
from tests.llm.test_jaccard import expected as classes


#: large enough for the classifier to reject documents
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == sorted(result.fetchall(), key=repr)


def test_every_operator_has_a_query():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14))


def test_pipeline_equals_its_stages_in_python(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    scored = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{LARGER}/labels.parquet"))).collect()
    rows = {r["doc_id"]: r["text"] for r in scored if r["score"] >= 0.3}
    assert len(rows) < len(scored)
    same = defaultdict(list)
    for i, t in rows.items():
        same[normal(t)].append(i)
    rows = {max(ids): rows[max(ids)] for ids in same.values()}
    found = classes(list(rows.items()))
    rows = {i: t for i, t in rows.items() if found[i][0] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    gone = {r[0] for r in leaks(list(rows.items()), items)}
    assert gone
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows.items() if i not in gone}
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, LARGER).collect()}
    assert got == want


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    docs = frame(spark, odd_rows() + [(50 + i, prose(i, 40)) for i in range(10)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns
        docs = spark.createDataFrame(left.collect(), docs.schema)
    assert 0 < corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_copies_of_a_text_whose_id_repeats_go(spark):
    """Document 5 holds two texts; the copies of either are judged by their own text."""
    a, b = prose(1, 60), prose(2, 60)
    near = b.replace(b.split()[30], "changed", 1)
    docs = frame(spark, [(5, a), (5, b), (77, b), (78, b), (79, near), (80, a), (4, "quite another text of seven words")])
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.distinct_content(spark, docs, SF).collect()]
    assert sorted(left) == sorted([(5, a), (5, b), (4, "quite another text of seven words")])


def test_stages_take_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), SF).count() == 0


def test_exact_stage_keeps_the_largest_id(spark):
    docs = frame(spark, [(1, "Same"), (2, "same"), (3, "other")])
    assert {r["doc_id"] for r in corpus_pipeline.distinct_texts(spark, docs, SF).collect()} == {2, 3}
    assert exact_dedup.exact_dedup(docs).where("kept").count() == 2
