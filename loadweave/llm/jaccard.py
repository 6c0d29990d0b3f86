"""Similarity join of documents on five-word shingles by chosen paths.

Documents of equal shingle sets are one class from the start. Every class is embedded as a
sequence of MinHash tokens, of which two sets share a share equal to their Jaccard similarity.
A run starts with all classes in one bucket and splits it on one or two sampled positions:
classes that share the token of the position go on together. Buckets of at most `SMALL` classes are
compared by brute force; larger ones are split again, each on its own sampled positions. A
bucket that hardly shrinks holds texts that are alike; it is compared in blocks, never in one task.
Two classes may meet in many buckets; only the first of their common buckets counts them.

Runs are repeated until the chance that a pair at the threshold was split apart in all of them is below
`MISS`, given the depth that was reached. Comparison is by sketch first; the pairs that may
reach the threshold are settled by their exact sets.

Links are counted and joined into groups inside the tasks, so no list of pairs is ever made.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loadweave.llm.cells import all_pairs, by_cell, cells_of, intersections, joined
from loadweave.llm.common import lean, side_of, stored, values, version
from loadweave.llm.components import components
from loadweave.llm.shards import join_counted
from loadweave.llm.words import WordHashes, mixed, runs

WORDS = 5
SIMILAR = 0.8
TOKENS = 128
#: Classes that are compared by brute force
SMALL = 1024
DEEPEST = 6
#: A child bucket with at least this share of its parent is not split further
DENSE = 0.5
#: Chance that a pair at the threshold is never compared
MISS = 1e-6
RUNS_AT_A_TIME = 6
#: Share of splits on two positions; the others are on one
TWICE = 0.4
#: Five standard deviations of the sketch's estimate at the threshold
SLACK = 5 * math.sqrt(SIMILAR * (1 - SIMILAR) / TOKENS)

_WORD = re.compile(r"[^\W_]+")
_FACTORS = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str, known: WordHashes | None = None) -> np.ndarray:
    """Sorted hashes of the text's distinct five-word shingles; shorter texts are one shingle, empty ones none."""
    words = _WORD.findall(text.lower())
    return np.unique(runs((WordHashes() if known is None else known).of(words), min(WORDS, max(1, len(words)))))


def tokens(shingles: np.ndarray) -> np.ndarray:
    """The MinHash token at each position."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[i : i + 2048, None] * _FACTORS).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, version, print, size, tokens): a fingerprint of the shingle set, its size and MinHash tokens (4 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = (shingle_set(t or "", known) for t in values(batch.column("text")))
            rows = [(xxhash.xxh3_128_digest(s.tobytes()), len(s), tokens(s).tobytes()) for s in sets]
            prints, sizes, sketches = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())],
                ["doc_id", "version", "print", "size", "tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", version().alias("version"), "text").mapInArrow(lean(run), f"doc_id {kind}, version long, print binary, size int, tokens binary")


def _token(position: Column) -> Column:
    return F.substring(F.col("tokens"), position * 4 + 1, F.lit(4))


def _split(rows: DataFrame, node: Column) -> DataFrame:
    """Send each row on along the one or two positions that its bucket samples."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(TOKENS)).cast("int")
    second = F.pmod(F.xxhash64(node, F.lit(2)), F.lit(TOKENS)).cast("int")
    twice = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(1000)) < int(1000 * TWICE)
    # the same position twice is the same child, once
    at = F.when(twice & (first != second), F.array(first, second)).otherwise(F.array(first))
    gone = rows.withColumn("at", F.explode(at))
    return gone.withColumn("node", F.xxhash64(node, F.col("at"), _token(F.col("at")))).drop("at")


def together(depth: int) -> float:
    """Chance that a pair at the threshold shares a bucket `depth` splits down in one run."""
    q = 1.0
    for _ in range(depth):
        q = 1 - (1 - TWICE) * (1 - SIMILAR * q) - TWICE * (1 - SIMILAR * q) ** 2
    return q


def _buckets(classes: DataFrame, first_run: int, n_runs: int) -> tuple[DataFrame, int]:
    """(rep, node, n): the final buckets of some runs, and the deepest split. Buckets of one are gone."""
    roots = classes.select("rep", "tokens", F.explode(F.array(*[F.lit(r).cast("long") for r in range(first_run, first_run + n_runs)])).alias("run"))
    level = _split(roots, F.xxhash64(F.lit("run"), F.col("run"))).select("rep", "tokens", "node").withColumn("above", F.lit(1 << 60))
    done, depth = [], 1
    while True:
        # counted with partial sums and joined back, so that no bucket has to fit into a task; stored in
        # between, so that the join is a stage of its own and a large bucket can be split
        counts = stored(level.groupBy("node").agg(F.count("*").alias("n"), F.max("above").alias("above")).where("n > 1"))
        large = (F.col("n") > SMALL) & (F.col("n") < DENSE * F.col("above")) & F.lit(depth < DEEPEST)
        done.append(stored(level.select("rep", "node").join(counts.where(~large).select("node", "n"), "node").select("rep", "node", "n")))
        split = stored(counts.where(large).select("node", F.col("n").alias("above")))
        if split.isEmpty():
            return reduce(DataFrame.unionByName, done), depth
        # large buckets are few, one for `SMALL` rows at most: they go to the classes, each of which finds its path
        # anew, so that the tokens stay where they are
        level = _split(level.drop("above").join(side_of(split), "node"), F.col("node")).select("rep", "tokens", "node", "above")
        depth += 1


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Large buckets dealt to pairs of blocks: (cell, side), where a cell with sides 0 and 1 is compared across only."""
    blocks = F.ceil(F.col("n") / SMALL).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    cells = F.when(blocks <= 1, F.array(F.struct(F.col("node").alias("cell"), F.lit(-1).alias("side")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), blocks - 1),
            lambda b: F.struct(
                F.xxhash64(F.col("node"), F.least(own, b), F.greatest(own, b)).alias("cell"),
                F.when(own == b, -1).when(own < b, 0).otherwise(1).cast("int").alias("side"),
            ),
        )
    )
    return rows.withColumn("c", F.explode(cells)).select("*", "c.cell", "c.side").drop("c", "n")


def _first_here(node: int, lists: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether this node is the first of the buckets that the two classes share."""
    width = max(map(len, lists))
    padded = np.full((len(lists), width), -1, np.int64)
    earlier = np.zeros((len(lists), width), bool)
    for row, own in enumerate(lists):
        padded[row, : len(own)] = own
        earlier[row, : len(own)] = own < node
    out = np.ones(len(i), bool)
    for k in range(0, len(i), 4096):
        a, b = i[k : k + 4096], j[k : k + 4096]
        met = (padded[a][:, :, None] == padded[b][:, None, :]) & earlier[a][:, :, None] & earlier[b][:, None, :]
        out[k : k + 4096] = ~met.any((1, 2))
    return out


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each cell that may reach the threshold with another member they first meet there."""
    for table in by_cell(batches):
        sketch = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(-1, TOKENS)
        sizes, sides, nodes = (table.column(c).to_numpy() for c in ("size", "side", "node"))
        near = table.column("nodes")
        keep = np.zeros(len(table), bool)
        for start, stop in cells_of(table):
            i, j = all_pairs(sides[start:stop])
            own_size = sizes[start:stop]
            could = np.minimum(own_size[i], own_size[j]) >= SIMILAR * np.maximum(own_size[i], own_size[j]) - 1e-9
            i, j = i[could], j[could]
            own = sketch[start:stop]
            alike = np.concatenate([np.zeros(0, bool), *[(own[i[k : k + 8192]] == own[j[k : k + 8192]]).mean(1) >= SIMILAR - SLACK for k in range(0, len(i), 8192)]])
            i, j = i[alike], j[alike]
            if len(i):
                lists = [np.array(x) for x in near.slice(start, stop - start).to_pylist()]
                here = _first_here(int(nodes[start]), lists, i, j)
                keep[start + i[here]] = keep[start + j[here]] = True
        yield from table.filter(pa.array(keep)).select(["cell", "side", "node", "rep", "nodes"]).combine_chunks().to_batches()


def _settle(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rep, links, root): links of each member that are counted in its cell, and the smallest member it is joined with."""
        for table in by_cell(batches):
            reps, weights, sides, nodes = (table.column(c).to_numpy() for c in ("rep", "members", "side", "node"))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for start, stop in cells_of(table):
                if stop - start < 2:
                    continue
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles").slice(start, stop - start)]
                rep, weight, side = reps[start:stop], weights[start:stop], sides[start:stop]
                both = intersections(sets)
                size = np.array(list(map(len, sets)))
                i, j = all_pairs(side)
                joint = both[i, j]
                similar = joint >= threshold * (size[i] + size[j] - joint) - 1e-6
                i, j = i[similar], j[similar]
                if not len(i):
                    continue
                root = joined(stop - start, i, j)
                lists = [np.array(x) for x in table.column("nodes").slice(start, stop - start).to_pylist()]
                here = _first_here(int(nodes[start]), lists, i, j)
                links = np.bincount(i[here], weight[j[here]], stop - start) + np.bincount(j[here], weight[i[here]], stop - start)
                out.append((rep, links.astype(np.int64), rep[root]))
            if out:
                rep, links, root = map(np.concatenate, zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(root)], ["rep", "links", "root"])

    return run


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class with one byte of every token, for estimates."""
    for batch in batches:
        rows = [np.frombuffer(t, np.uint8)[::4].tobytes() for t in values(batch.column("tokens"))]
        i = batch.schema.get_field_index("tokens")
        yield batch.set_column(i, "bytes", pa.array(rows, pa.binary()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for batch in batches:
        for i in range(0, len(batch), 512):
            part = batch.slice(i, 512)
            sets = [shingle_set(t or "", known).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(sets, pa.binary())], ["rep", "shingles"])


def jaccard_join(docs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """One row per document: (doc_id, version, class_id, n_links); the version, a hash of the text, tells rows of one doc_id apart.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles (lower-cased runs of letters
    and digits) is at least `threshold`, which may not be below 0.8. `n_links` counts the other documents linked to
    this one, copies included; `class_id` is the smallest doc_id among all that links connect with it.

    Defined cases: a text of one to four words is one shingle of all its words; null and empty texts have none and are
    linked to nothing; a row without a doc_id has a null class and no links; rows that repeat are documents of their
    own and link to each other; rows that repeat a doc_id with other words are told apart by their sets;
    other columns are ignored; no rows give no rows.
    """
    if threshold < SIMILAR:
        raise ValueError("the runs are laid out for similarities from 0.8")
    seen = stored(sketched(docs))
    usable = seen.where("doc_id IS NOT NULL AND size > 0").withColumnRenamed("print", "rep")
    # a class is named by the print of its set, so that texts which share a doc_id stay apart
    classes = usable.groupBy("rep").agg(F.count("*").alias("members"), F.min("doc_id").alias("first"))
    classes = stored(classes.join(usable.select("rep", "size", "tokens").dropDuplicates(["rep"]), "rep"))

    found, runs_done, need = [], 0, RUNS_AT_A_TIME
    while runs_done < need:
        rows, depth = _buckets(classes, runs_done, RUNS_AT_A_TIME)
        found.append(rows)
        runs_done += RUNS_AT_A_TIME
        need = max(need, math.ceil(math.log(MISS) / math.log(1 - together(depth))))
    buckets = reduce(DataFrame.unionByName, found)

    lists = buckets.groupBy("rep").agg(F.array_sort(F.collect_set("node")).alias("nodes"), F.collect_set(F.struct("node", "n")).alias("met"))
    sketch = classes.select("rep", "size", "tokens").mapInArrow(lean(_low_bytes), "rep binary, size int, bytes binary")
    placed = _in_blocks(lists.join(sketch, "rep").select("rep", "size", "bytes", "nodes", F.explode("met").alias("m")).select("rep", "size", "bytes", "nodes", "m.*"))
    cells = placed.repartition("cell").sortWithinPartitions("cell")
    kept = stored(cells.select("cell", "side", "node", "rep", "size", "bytes", "nodes").mapInArrow(lean(_promising), "cell long, side int, node long, rep binary, nodes array<long>"))

    # one row of each class gives its text
    wanted = kept.select("rep").distinct().join(usable.select("rep", "doc_id", "version"), "rep").dropDuplicates(["rep"])
    texts = docs.select("doc_id", version().alias("version"), "text").join(side_of(stored(wanted)), ["doc_id", "version"])
    sets = texts.mapInArrow(lean(_sets), "rep binary, shingles binary").dropDuplicates(["rep"]).join(classes.select("rep", "members"), "rep")
    full = kept.join(sets.select("rep", "members", "shingles"), "rep").repartition("cell").sortWithinPartitions("cell")
    settled = stored(full.select("cell", "side", "node", "rep", "members", "nodes", "shingles").mapInArrow(lean(_settle(threshold)), "rep binary, links long, root binary"))

    links = settled.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(settled.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    judged = classes.select("rep", "first", "members").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    judged = stored(judged.withColumn("component", F.coalesce("component", "rep")))
    least = stored(judged.groupBy("component").agg(F.count("*").alias("n"), F.min("first").alias("class_id")))
    judged = join_counted(judged, least, "component")
    facts = stored(judged.select(F.col("rep").alias("print"), F.col("members").alias("n"), "class_id", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = join_counted(seen.select("doc_id", "version", "print", "size"), facts, "print")
    usable = F.col("doc_id").isNotNull() & (F.col("size") > 0)
    return out.select("doc_id", "version", F.when(usable, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(usable, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
