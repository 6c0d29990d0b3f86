"""From raw documents to token ids: each stage works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loadweave.llm import decontaminate, exact_dedup, jaccard, quality
from loadweave.llm.common import bounded_side, free_name, stored, table, version
from loadweave.llm.queries import token_digests

#: Ids of dropped documents up to which they are broadcast: up to 16 bytes each
SIDE_ROWS = 1_000_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier predicts to be good.

    Null and empty texts take the intercept's score; rows that repeat, or have no doc_id, are judged one by one; other columns, of any name,
    stay as they are; no rows give no rows.
    """
    score = free_name("score", docs)
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id.

    Texts are equal when identical after lower-casing A-Z, null as empty; rows that repeat the largest id all stay, as do rows
    without an id; an id with several texts loses only those that are dropped; other columns, of any name, stay; no rows give no rows.
    """
    gone = exact_dedup.exact_dedup(docs).where("NOT kept AND doc_id IS NOT NULL")
    name = free_name("version", docs)
    gone = stored(gone.select("doc_id", F.xxhash64("text_sha256").alias(name)).distinct())
    told = docs.withColumn(name, F.xxhash64(exact_dedup.digest(docs)))
    return told.join(bounded_side(gone, SIDE_ROWS), ["doc_id", name], "left_anti").select(docs.columns)


def distinct_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id.

    A row goes by its own text, so of rows that share an id each is judged by itself; null and empty texts, and rows without an id, stay;
    rows that repeat stay or go together; other columns, of any name, stay; no rows give no rows.
    """
    judged = jaccard.jaccard_join(docs).where("class_id <> doc_id AND doc_id IS NOT NULL")
    name = free_name("version", docs)
    gone = stored(judged.select("doc_id", F.col("version").alias(name)).distinct())
    told = docs.withColumn(name, version())
    return told.join(bounded_side(gone, SIDE_ROWS), ["doc_id", name], "left_anti").select(docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item.

    Null and empty texts hold none; rows that repeat an id count as one document with the words of all of them and go together; rows without an
    id stay; other columns, of any name, stay; no rows give no rows.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens of each document, and digests of its ids and of their decoding.

    Null and empty texts have no tokens; rows that repeat come out as often; a null id stays null; other columns are left out; no
    rows give no rows.
    """
    return token_digests(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", distinct_content),
    ("benchmark decontamination", no_benchmark),
    ("BPE encoding and decoding", tokens),
]
#: The first stage is a trained model, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
