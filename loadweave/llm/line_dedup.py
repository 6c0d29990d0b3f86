"""Line deduplication against levelled sorted runs of line hashes.

A run is a sorted, immutable table of (key, n_docs, owner). Each new batch of documents is
reduced to its distinct line hashes, merge-anti-joined with the runs to tell new lines from
known ones, and written as a run of its own at level 0. When a level holds `FANOUT` runs,
they are merged into one run of the next level, so a line is rewritten once per level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loadweave.llm.common import BLANKS, lower_ascii, side_of, stored, version, whole
from loadweave.llm.shards import join_counted

FANOUT = 3


class LineRuns:
    """Levelled sorted runs: levels[i] lists the runs of level i, the oldest first."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, [[]]

    def all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    @staticmethod
    def _sorted_run(rows: DataFrame) -> DataFrame:
        return stored(rows.select("key", "n_docs", "owner").repartitionByRange("key").sortWithinPartitions("key"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Take a batch of (key, n_docs, last_id), a row per key; return the rows of keys seen for the first time.

        The batch that brings a key first owns it: its largest doc_id is kept as `owner`.
        """
        known = self.all()
        if known is None:
            new, run = batch, batch.withColumn("owner", F.col("last_id"))
        else:
            keys = known.select("key").distinct()
            new = batch.join(keys, "key", "left_anti")
            old = batch.join(keys, "key", "left_semi")
            run = new.withColumn("owner", F.col("last_id")).unionByName(old.withColumn("owner", F.lit(None).cast(batch.schema["last_id"].dataType)))
        self.levels[0].append(self._sorted_run(run))
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                merged = reduce(DataFrame.unionByName, self.levels[i])
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._sorted_run(self.merged(merged)))
                self.levels[i] = []
        return new

    @staticmethod
    def merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))


def _line_hash(key: Column) -> Column:
    """The first 128 bits of the line's SHA-256."""
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, version, at, key): every line whose normalised form has `min_chars` code points, by position in its row."""
    lines = lines_of(lower_ascii(whole(docs["text"])))
    line = docs.select("doc_id", version().alias("version"), F.posexplode(lines).alias("at", "line")).select("doc_id", "version", "at", F.btrim("line", F.lit(BLANKS)).alias("line"))
    return line.where(F.length("line") >= min_chars).select("doc_id", "version", "at", _line_hash(F.col("line")).alias("key"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 3) -> DataFrame:
    """One row per document: (doc_id, n_lines, n_dropped, kept_text).

    Lines are split at \\n. A line's key is the line stripped of blanks at both ends with A-Z lower-cased.
    A key of at least `min_chars` code points found in at least `min_docs` documents loses all its lines
    except those in the largest doc_id that holds it. Batches are ranges of doc_id from the largest down,
    so the batch that brings a key first holds its owner.

    Defined cases: null and empty texts are one empty line; rows that repeat a doc_id are one document
    when documents are counted, and each loses its own lines; a row without a doc_id owns and loses
    nothing and does not count; ties cannot occur; extra columns are ignored; no rows give no rows.
    """
    rows = docs.select("doc_id", "text")
    bounds = [b for b in rows.approxQuantile("doc_id", [1 - i / batches for i in range(1, batches)], 0.01)]
    batch = reduce(lambda c, b: c + F.when(F.col("doc_id") < b, 1).otherwise(0), bounds, F.lit(0))
    known = rows.where("doc_id IS NOT NULL")
    lines = stored(keyed_lines(known, min_chars).withColumn("batch", batch))
    per_doc = lines.select("batch", "doc_id", "key").distinct()
    # partial sums before the shuffle: a line that most documents share is one row per task
    per_key = stored(per_doc.groupBy("batch", "key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_id")))
    runs = LineRuns()
    for number in range(batches):
        runs.add(per_key.where(F.col("batch") == number).drop("batch"))
    often = stored(LineRuns.merged(runs.all()).where(F.col("n_docs") >= min_docs).select("key", "owner", F.col("n_docs").alias("n")))
    # the lines of a key that very many documents hold stay where they are
    lost = join_counted(lines, often, "key").where(F.col("doc_id") != F.col("owner")).select("doc_id", "version", "at").distinct()
    lost = stored(lost.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("at")).alias("lost")))
    # only the texts that lose lines meet their places
    told = rows.withColumn("version", version())
    ids = side_of(stored(lost.select("doc_id", "version")))
    whole_ones = told.join(ids, ["doc_id", "version"], "left_anti").withColumn("lost", F.array().cast("array<int>"))
    held = told.join(ids, ["doc_id", "version"], "left_semi").join(lost, ["doc_id", "version"]).unionByName(whole_ones)
    held = held.withColumn("lines", lines_of(whole("text")))
    # the stretches between lost lines, so the work is linear in the number of lines
    starts = F.concat(F.array(F.lit(1)), F.transform("lost", lambda p: p + 2))
    ends = F.concat(F.transform("lost", lambda p: p + 1), F.array(F.size("lines") + 1))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice("lines", s, e - s)))
    return held.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"),
        F.when(F.size("lost") == 0, whole("text")).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
