"""How quality filters interact, from a document-term matrix of the whole corpus.

The words of all documents are coded by one dictionary; each shard of documents becomes a sparse matrix of word
counts in CSR form. A row's sum is the number of words, its number of entries that of distinct words: these two decide
the filters A and B. The flags of C, D and E are attached to the rows. A document is then known by the set of filters
that it fails, and all orders of the filters follow from the number of documents for each such set.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from loadweave.llm.common import lean, stored, whole
from loadweave.llm.shards import answered, coded_words, cut, dictionary, hashes_of, join_counted, numbered, row_sums, sparse_rows

FILTERS = "ABCDE"
#: A: fewer words than this fail
LEAST_WORDS = 100
#: B: a smaller share of distinct words fails, in percent
DISTINCT = 80
#: C: a larger share of A-Z among the code points fails, in percent
CAPITALS = 10
#: D: any of these fails
SYMBOLS = "#$%&*|"

_CAPITALS, _SYMBOLS = ascii_uppercase.encode(), SYMBOLS.encode()


def _counted(texts: list[bytes]) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct words of some texts in the order of their hashes, and each text's (places among these, counts)."""
    codes: dict[bytes, int] = {}
    rows = []
    for text in texts:
        words = Counter(text.split())
        own = [codes.setdefault(w, len(codes)) for w in words]
        rows.append((np.array(own, np.int32), np.fromiter(words.values(), np.int32, len(words))))
    met = list(codes)
    order = np.argsort(hashes_of(met), kind="stable")
    place = np.empty(len(met), np.int32)
    place[order] = np.arange(len(met))
    return [met[i] for i in order], [(place[c], n) for c, n in rows]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = numbered(TaskContext.get().partitionId())
    for batch in batches:
        for part in cut(batch.column("size").to_numpy()):
            here = batch.slice(part.start, part.stop - part.start)
            some = [t or "" for t in here.column("text").to_pylist()]
            raw = [t.encode() for t in some]
            words, rows = _counted(raw)
            indptr, indices, data = sparse_rows(rows)
            out = {
                "shard": pa.array([next(numbers)], pa.int64()),
                "doc_ids": _one_list(here.column("doc_id")),
                "parts": _one_list(here.column("part")),
                "capitals": pa.array([[100 * (len(b) - len(b.translate(None, _CAPITALS))) > CAPITALS * len(t) for b, t in zip(raw, some)]], pa.list_(pa.bool_())),
                "symbols": pa.array([[len(b) != len(b.translate(None, _SYMBOLS)) for b in raw]], pa.list_(pa.bool_())),
                "digests": pa.array([[sha256(b).digest() for b in raw]], pa.list_(pa.binary())),
                "indptr": pa.array([indptr.tobytes()], pa.binary()),
                "indices": pa.array([indices.astype(np.int32).tobytes()], pa.binary()),
                "counts": pa.array([data.astype(np.int32).tobytes()], pa.binary()),
                "n_keys": pa.array([len(words)], pa.int64()),
                "words": pa.array([b" ".join(words)], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(out)


def _one_list(column: pa.Array) -> pa.Array:
    """The whole column as one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def document_term_matrix(docs: DataFrame, part: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(matrix, dictionary): CSR shards of word counts over the words of all whole texts, and (key, id) of the words.

    A shard's row has `doc_ids`, `parts`, `capitals`, `symbols` and `digests`, lists with an entry for each matrix row,
    and the CSR arrays as bytes: `indptr` (int64), `indices` (int64, ids of the dictionary), `counts` (int32).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    flags = f"doc_ids array<{kind}>, parts array<string>, capitals array<boolean>, symbols array<boolean>, digests array<binary>"
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.octet_length(whole()).alias("size"), "text")
    csr = f"shard long, {flags}, indptr binary, indices binary, counts binary"
    shards = stored(rows.mapInArrow(lean(_shards), f"{csr}, n_keys long, words binary"))
    pieces = coded_words(shards)

    def coded(row: dict, found: dict[str, list]) -> dict:
        codes = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in found["codes"])])
        return row | {"indices": codes[np.frombuffer(row["indices"], np.int32)].tobytes()}

    return answered(shards.drop("n_keys", "words"), pieces.withColumnRenamed("first", "at"), ["codes"], coded, csr), dictionary(pieces)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            indptr = np.frombuffer(row.column("indptr")[0].as_py(), np.int64)
            counts = np.frombuffer(row.column("counts")[0].as_py(), np.int32).astype(np.int64)
            flat = {n: row.column(c).flatten() for n, c in (("doc_id", "doc_ids"), ("part", "parts"), ("capitals", "capitals"), ("symbols", "symbols"), ("digest", "digests"))}
            yield pa.RecordBatch.from_pydict(flat | {"n_words": pa.array(row_sums(indptr, counts)), "n_distinct": pa.array(np.diff(indptr))})


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, n_words, n_distinct, fails): for each document the filters that it fails, as bits from A = 1 to E = 16.

    Each repeated row is judged by itself; E compares whole texts by their SHA-256, null as empty, and fails a row if a smaller doc_id
    has the same text. A row without a doc_id neither fails E nor makes others fail.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    matrix, _ = document_term_matrix(docs, part)
    rows = stored(matrix.mapInArrow(lean(_sums), f"doc_id {kind}, part string, capitals boolean, symbols boolean, digest binary, n_words long, n_distinct long"))
    copies = stored(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1"))
    rows = join_counted(rows, copies, "digest")
    tests = [
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < DISTINCT * F.col("n_words"),
        F.col("capitals"),
        F.col("symbols"),
        F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)),
    ]
    bits = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    return rows.select("doc_id", "part", "n_words", "n_distinct", bits.alias("fails"))


ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _with_steps(sets: DataFrame) -> DataFrame:
    """Every row with all steps of all orders: (filter_order, step, own, before), the last two as bits."""
    rows = sets.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ",")))
    # one bit for each letter, in the order of the filters
    rows = rows.withColumn("bits", F.transform(F.split("filter_order", ""), lambda x: F.pow(F.lit(2), F.ascii(x) - ord(FILTERS[0])).cast("int")))
    rows = rows.select("*", F.posexplode("bits").alias("past", "own"))
    before = F.aggregate(F.slice("bits", 1, F.col("past")), F.lit(0), lambda x, y: x + y)
    return rows.select(*sets.columns, "filter_order", (F.col("past") + 1).alias("step"), "own", before.alias("before"))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """For each part, order of the filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    `labels` has (doc_id, quality, toxic); a document that occurs there more often counts as marked if any of its rows is.

    Defined cases: null texts are empty, fail A and are copies of each other; an empty text has no capitals to fail C and, without
    words, does not fail B; rows that repeat are counted as often; a null part is the empty string, as is an empty one;
    documents without labels are neither good nor toxic; other columns are ignored; no rows give no rows.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    judged = failures(docs, part).select("doc_id", "part", "fails").join(marks, "doc_id", "left")
    # at most 32 rows for each part: all else follows from them
    sets = judged.groupBy("part", "fails").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    steps = _with_steps(stored(sets))
    fails, own, before = F.col("fails"), F.col("own"), F.col("before")
    here = (fails.bitwiseAND(own) != 0) & (fails.bitwiseAND(before) == 0)
    late = (fails.bitwiseAND(own) != 0) & (fails.bitwiseAND(before) != 0)

    def total(test: Column, value: str, name: str) -> Column:
        return F.sum(F.when(test, F.col(value)).otherwise(0)).cast("long").alias(name)

    # of the filters that a document fails, each comes first in the same share of all orders
    share = F.when(fails.bitwiseAND(own) != 0, F.col("n") * (F.lit(len(ORDERS)) / F.bit_count("fails")).cast("long")).otherwise(0)
    return steps.groupBy("part", "filter_order", "step").agg(
        total(fails.bitwiseAND(own.bitwiseOR(before)) == 0, "n", "kept"),
        total(here, "n", "removed"),
        total(late, "n", "redundant"),
        total(fails == own, "n", "unique_fails"),
        total(here, "good", "good_lost"),
        total(here, "toxic", "toxic_lost"),
        F.sum(share).cast("long").alias("shapley"),
    )
