"""Exact deduplication over immutable snapshots screened by binary-fuse filters.

Documents arrive in batches. Rows of one batch are first grouped by the digest of their
text, with partial sums, so that a text held by a third of all rows is one row per task.
The distinct digests are then screened by the static binary-fuse filters of the earlier
snapshots. Only digests that some filter lets pass join the exact buckets of that snapshot,
where the texts themselves are compared. The batch then becomes a snapshot with filters
of its own and is never changed.

Filters are built and asked in shards of the digest space, about `SHARD_KEYS` keys each,
so neither the filter nor the keys of a snapshot are ever in one place.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loadweave.llm.common import bounded_side, lower_ascii, stored, whole

SHARD_KEYS = 1 << 18
#: Rows up to which a list of document ids is broadcast: 8 bytes each
PROBE_ROWS = 1_000_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class BinaryFuse:
    """A static three-way binary-fuse filter with 16-bit fingerprints.

    `keys` are distinct unsigned 64-bit hashes. A member always passes; another key
    passes with probability 2**-16.
    """

    def __init__(self, seed: int, segment: int, cells: np.ndarray):
        self.seed, self.segment, self.cells = seed, segment, cells

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = _mix(keys + np.uint64(seed) * _GOLDEN)
            g = _mix(h ^ _GOLDEN)
        starts = np.uint64(size // segment - 2)
        first = ((h >> np.uint64(32)) * starts >> np.uint64(32)).astype(np.int64) * segment
        mask = np.uint64(segment - 1)
        inside = [(g >> np.uint64(s)) & mask for s in (0, 20, 40)]
        slots = np.stack([first + i * segment + x.astype(np.int64) for i, x in enumerate(inside)])
        return slots, (h & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = min(1 << 18, 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25)))
        wanted = n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
        size = (max(1, math.ceil(wanted / segment) - 2) + 2) * segment
        for seed in range(1, 200):
            slots, prints = cls._slots(keys, seed, segment, size)
            order = cls._peel(slots, size)
            if order is None:
                size += segment if seed % 10 == 0 else 0
                continue
            cells = np.zeros(size, np.uint16)
            for picked, cell in reversed(order):
                a, b, c = slots[:, picked]
                # the cell itself still holds zero, so the three-way sum is that of the other two
                cells[cell] = prints[picked] ^ cells[a] ^ cells[b] ^ cells[c]
            return cls(seed, segment, cells)
        raise RuntimeError("no seed gave a filter")

    @staticmethod
    def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the cell that only this key uses by then); None if keys are left."""
        n = slots.shape[1]
        degree = np.bincount(slots.ravel(), minlength=size)
        keys = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(keys, row, np.arange(n))
        order, left = [], n
        while left:
            cell = np.flatnonzero(degree == 1)
            picked, at = np.unique(keys[cell], return_index=True)
            if not len(picked):
                return None
            order.append((picked, cell[at]))
            left -= len(picked)
            for row in slots[:, picked]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(keys, row, picked)
        return order

    def __contains__(self, key: int) -> bool:
        return bool(self.passes(np.array([key], np.uint64))[0])

    def passes(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(keys.astype(np.uint64), self.seed, self.segment, len(self.cells))
        a, b, c = self.cells[slots]
        return (a ^ b ^ c) == prints


def digest(docs: DataFrame) -> Column:
    """The digest of each row's text; null texts count as empty."""
    return F.sha2(lower_ascii(whole(docs["text"])), 256)


def with_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of every row."""
    return docs.select("doc_id", digest(docs).alias("text_sha256"))


def _key(digest: str = "text_sha256"):
    """The first 60 bits of the digest as a long."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _shards(keys: int) -> int:
    return max(1, math.ceil(keys / SHARD_KEYS))


def snapshot_filters(rows: DataFrame) -> DataFrame:
    """(shard, shards, seed, segment, cells): one static filter for each shard of a snapshot's digests."""
    shards = _shards(rows.count())

    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = BinaryFuse.build(part["key"].to_numpy())
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "seed": [made.seed], "segment": [made.segment], "cells": [made.cells.tobytes()]})

    keyed = rows.select(_key().alias("key")).withColumn("shard", F.pmod("key", F.lit(shards)))
    made = keyed.groupBy("shard").applyInPandas(build, "shard long, seed int, segment int, cells binary")
    return made.withColumn("shards", F.lit(shards))


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The incoming distinct digests that a snapshot's filters let pass (all its members, and few others)."""

    def ask(part: pd.DataFrame, built: pd.DataFrame) -> pd.DataFrame:
        if part.empty or built.empty:
            return part.loc[[], ["text_sha256"]]
        f = built.iloc[0]
        fuse = BinaryFuse(int(f["seed"]), int(f["segment"]), np.frombuffer(f["cells"], np.uint16))
        return part.loc[fuse.passes(part["key"].to_numpy()), ["text_sha256"]]

    keyed = incoming.select("text_sha256", _key().alias("key")).withColumn("shard", F.pmod("key", F.lit(shards)))
    return keyed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(ask, "text_sha256 string")


class Snapshots:
    """A growing store of exact texts: `add` takes a batch, `rows` holds every snapshot's buckets.

    A bucket row is (snapshot, text_sha256, n, last_id, class_key): how many rows of that
    snapshot have the text, the largest doc_id among them, and the last_id of the snapshot
    that had the text first, which together with the digest names the text over all snapshots.
    """

    def __init__(self, docs: DataFrame):
        """`docs` is where texts are looked up for byte checks."""
        self.docs, self.taken = docs, []

    def add(self, batch: DataFrame) -> DataFrame:
        """Take a batch of (doc_id, text_sha256) rows; return its bucket rows."""
        number = len(self.taken)
        grouped = stored(batch.groupBy("text_sha256").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id")))
        known = None
        for buckets, filters, shards in self.taken:
            maybe = screen(grouped, filters, shards)
            hits = buckets.join(maybe, "text_sha256").select("text_sha256", F.col("last_id").alias("old_id"), F.col("class_key").alias("old_key"))
            known = hits if known is None else known.unionByName(hits)
        # rows without an id have their digest for a name
        rows = grouped.withColumns({"snapshot": F.lit(number), "class_key": F.coalesce(F.col("last_id").cast("string"), F.col("text_sha256"))})
        if known is None:
            rows = rows.withColumn("old_key", F.lit(None).cast("string"))
        else:
            same = self._same_bytes(stored(grouped.join(known, "text_sha256").select("text_sha256", "last_id", "old_id", "old_key")))
            rows = rows.join(same.groupBy("text_sha256").agg(F.max("old_key").alias("old_key")), "text_sha256", "left")
            rows = rows.withColumn("class_key", F.coalesce("old_key", "class_key"))
        rows = stored(rows)
        # a text known before is found in the snapshot that had it first
        fresh = rows.where("old_key IS NULL")
        filters = stored(snapshot_filters(fresh))
        self.taken.append((fresh, filters, _shards(fresh.count())))
        return rows

    def _same_bytes(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose two texts are equal byte by byte; without an id on either side the digest decides."""
        ids = pairs.select(F.explode(F.array("last_id", "old_id")).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        texts = self.docs.select("doc_id", lower_ascii(whole(self.docs["text"])).alias("body"))
        texts = stored(texts.join(bounded_side(stored(ids), PROBE_ROWS), "doc_id", "left_semi"))
        new = texts.select(F.col("doc_id").alias("last_id"), F.col("body").alias("new_body"))
        old = texts.select(F.col("doc_id").alias("old_id"), F.col("body").alias("old_body"))
        equal = pairs.join(new, "last_id").join(old, "old_id").where("new_body = old_body")
        unnamed = pairs.where("last_id IS NULL OR old_id IS NULL")
        return equal.select("text_sha256", "old_key").unionByName(unnamed.select("text_sha256", "old_key"))


def exact_dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with
    the largest doc_id of each text stays. The documents are taken as `batches` batches.

    Defined cases: rows without a doc_id count in group_size and are never kept, unless all rows
    of the text lack one, when keep_id is null; repeated rows (same doc_id and text) all count and
    share one decision; a doc_id with several texts is judged with each of them by itself; extra columns are ignored; an empty table gives an empty result.
    """
    digests = stored(with_digest(docs).withColumn("batch", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(batches)).cast("int")))
    store, buckets = Snapshots(docs), None
    for number in range(batches):
        rows = store.add(digests.where(F.col("batch") == number))
        buckets = rows if buckets is None else buckets.unionByName(rows)
    # a class has one digest; with it, two texts that share their largest doc_id are two classes
    one = ["text_sha256", "class_key"]
    classes = buckets.groupBy(*one).agg(F.sum("n").alias("group_size"), F.max("last_id").alias("keep_id"))
    decided = buckets.join(classes, one).select("text_sha256", F.col("snapshot").alias("batch"), "keep_id", "group_size")
    return digests.join(decided, ["text_sha256", "batch"]).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"
    )
