"""Sparse rows in shards, whose columns are coded by a dictionary of the whole corpus.

A task cuts its documents into shards of a few MB. A shard holds its rows in compressed sparse row form (CSR)
with a dictionary of its own: `keys`, in the order of the local codes. Only these keys are shuffled, once for each
shard, to meet what is known of them corpus-wide; a key that every document holds is one row for each shard.
The answers go back to the shards by their numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loadweave.llm.common import lean, stored
from loadweave.llm.words import word_hashes

#: Bytes of text after which a shard is closed; a longer text is a shard by itself
SHARD_BYTES = 4 << 20
#: Words of all shards that a bucket of the dictionary has about ...
BUCKET_KEYS = 1 << 16
#: ... and words that a shard sends to a bucket at least, on average
LEAST_PIECE = 16
#: Keys that hold more rows than this are broadcast ...
HOT_ROWS = 10_000
#: ... and these are at most so many
MOST_HOT = 10_000


def numbered(part: int) -> Iterator[int]:
    """Numbers of the shards of one task: a task that runs again gives the same ones."""
    return iter(range(part << 32, (part + 1) << 32))


def cut(sizes: Sequence[int]) -> Iterator[slice]:
    """The rows of a batch in stretches of about `SHARD_BYTES`."""
    start = size = 0
    for i, own in enumerate(sizes):
        size += int(own)
        if size >= SHARD_BYTES:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def sparse_rows(rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indptr, indices, data) of rows given as (columns, values)."""
    indptr = np.cumsum([0, *(len(c) for c, _ in rows)], dtype=np.int64)
    empty = [np.zeros(0, np.int64)]
    return indptr, np.concatenate(empty + [c for c, _ in rows]), np.concatenate(empty + [v for _, v in rows])


def row_sums(indptr: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of each row's values."""
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[indptr[1:]] - sums[indptr[:-1]]


def key_rows(shards: DataFrame) -> DataFrame:
    """(shard, at, key): the local dictionaries, a row for each key."""
    return shards.select("shard", F.posexplode("keys").alias("at", "key"))


def coded_words(words: DataFrame) -> DataFrame:
    """(shard, first, codes, bucket, fresh) for (shard, n_keys, words): the corpus-wide code of every word of every shard.

    `words` are a shard's distinct words, joined by spaces, in the order of their hashes; so the words of a bucket, a range of hashes,
    stand together. They travel in one piece for each shard and bucket, not in a row for each word. A task takes the pieces of a bucket one after
    the other and numbers its words as they come; it holds the distinct words of one bucket and no list of who has them. The
    code is that number times the number of buckets, plus the bucket.

    The rows, the pieces, are stored; `first` is the place of the first word in its shard, `codes` are
    64-bit integers and `fresh` the words met first in this piece.
    """
    size = words.agg(F.sum("n_keys"), F.count("*")).first()
    keys, shards = int(size[0] or 0), max(1, size[1])
    bits = max(0, min(keys // BUCKET_KEYS, keys // shards // LEAST_PIECE).bit_length())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, text in zip(batch.column("shard").to_pylist(), batch.column("words")):
                own = text.as_py().split()
                bucket = buckets_of(hashes_of(own), bits)
                starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if own else np.zeros(0, int)
                stops = [*starts[1:], len(own)]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(bucket[starts], pa.int32()), "shard": pa.array([shard] * len(starts), pa.int64()), "first": pa.array(starts, pa.int32()),
                    "words": pa.array([b" ".join(own[i:j]) for i, j in zip(starts, stops)], pa.binary()),
                })

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = -1, {}
        for batch in batches:
            buckets, codes, fresh = batch.column("bucket").to_pylist(), [], []
            for bucket, text in zip(buckets, batch.column("words")):
                if bucket != at:
                    at, known = bucket, {}
                own, before = text.as_py().split(), len(known)
                codes.append((np.array([known.setdefault(w, len(known)) for w in own], np.int64) << bits | bucket).tobytes())
                fresh.append(b" ".join(list(islice(reversed(known), len(known) - before))[::-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("first"), pa.array(codes, pa.binary()), batch.column("bucket"), pa.array(fresh, pa.binary())], ["shard", "first", "codes", "bucket", "fresh"]
            )

    parts = words.select("shard", "words").mapInArrow(lean(split), "bucket int, shard long, first int, words binary")
    # in a fixed order, so that a task that runs again gives the same codes
    dealt = parts.repartition("bucket").sortWithinPartitions("bucket", "shard")
    return stored(dealt.mapInArrow(lean(number), "shard long, first int, codes binary, bucket int, fresh binary"))


def hashes_of(words: list[bytes]) -> np.ndarray:
    return word_hashes([b" ".join(words)])[0]


def buckets_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(hashes), np.int32)


def dictionary(pieces: DataFrame) -> DataFrame:
    """(key, id) of every word of `coded_words`: its fresh words, with the same codes."""
    words = pieces.select(F.col("fresh").cast("string"), "codes").where("fresh <> ''")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for text, codes in zip(batch.column("fresh"), batch.column("codes")):
                own = text.as_py().split(" ")
                # fresh words have the largest codes of their piece
                ids.append(np.sort(np.frombuffer(codes.as_py(), np.int64))[-len(own) :])
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *ids]))], ["key", "id"])

    return words.mapInArrow(spell, "key string, id long")


def answered(shards: DataFrame, answers: DataFrame, columns: Sequence[str], work: Callable[[dict, dict[str, np.ndarray]], dict], schema: str) -> DataFrame:
    """Each shard with the answers to its keys: `work(shard's row, {column: values in local order})` gives a row of `schema`.

    `answers` has (shard, at, *columns), a row for each key of each shard.
    """
    fields = StructType.fromDDL(schema)
    names, types = fields.names, to_arrow_schema(fields).types

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("at").to_numpy())
        found = {c: right.column(c).to_numpy(zero_copy_only=False)[order] for c in columns}
        rows = [work(row, found) for row in left.to_pylist()]
        return pa.table({n: pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)})

    right = answers.select(F.col("shard").alias("of"), "at", *columns)
    return shards.drop("keys").groupBy("shard").cogroup(right.groupBy("of")).applyInArrow(one, schema)


def join_counted(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """`rows` left-joined with stored facts: (key, n, ...), where n is the number of rows that hold the key.

    The facts of hot keys are broadcast, so that their rows stay where they are: a fact is hot if it holds over 1 / MOST_HOT of all
    counted rows, so there are fewer than MOST_HOT of them at any size.
    """
    total, most = facts.agg(F.sum("n"), F.max("n")).first()
    limit = max(HOT_ROWS, (total or 0) // MOST_HOT)
    if (most or 0) <= limit:
        return rows.join(facts, key, "left")
    heads = F.broadcast(stored(facts.where(F.col("n") > limit)))
    warm = rows.join(heads, key)
    return rows.join(heads.select(key), key, "left_anti").join(facts.where(F.col("n") <= limit), key, "left").unionByName(warm)
