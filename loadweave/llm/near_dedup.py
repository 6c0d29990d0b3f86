"""Near-duplicate documents by MinHash banding.

Documents of equal shingle sets are one class. Each class has `BANDS * ROWS` minima, each of its own universal hash function; classes
that agree in all minima of a band share a bucket. The members of a bucket are compared by their signatures,
one byte of every minimum, and what may reach the threshold is settled by the full sets. Links become
groups by alternating large-star and small-star.

A pair at the threshold shares no bucket with a chance of (1 - 0.85 ** ROWS) ** BANDS, under 3e-7.

Buckets of up to `SMALL` classes are compared by brute force inside a task. In a larger one all members are first compared
with one of them, its leader, in blocks; then only the members that this has not joined with the leader, the strays, are compared
with all others, in pairs of blocks. So a large group of copies is compared along a star, no pairs are listed, and
none is left out: two members that are both joined with the leader are connected already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loadweave.llm.cells import all_pairs, by_cell, cells_of, intersections, joined
from loadweave.llm.common import lean, side_of, stored, values, version
from loadweave.llm.shards import join_counted
from loadweave.llm.stars import components
from loadweave.llm.words import mixed, runs, word_hashes

WORDS = 5
PERCENT = 85
BANDS = 32
ROWS = 6
#: Classes that are compared by brute force
SMALL = 1024
#: Two sets that differ can only be linked if both have so many shingles
LEAST = math.ceil(PERCENT / (100 - PERCENT))
#: Five standard deviations of the signature's estimate at the threshold
SLACK = 5 * math.sqrt(PERCENT / 100 * (1 - PERCENT / 100) / (BANDS * ROWS))

_N = BANDS * ROWS
# multiply-add-shift: universal for 32-bit values
_FACTOR = mixed(np.arange(1, _N + 1, dtype=np.uint64)) | np.uint64(1)
_TERM = mixed(np.arange(_N + 1, 2 * _N + 1, dtype=np.uint64))
_FOLD = mixed(np.arange(2 * _N + 1, 3 * _N + 1, dtype=np.uint64)).reshape(BANDS, ROWS) | np.uint64(1)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct five-word shingles; fewer words are one shingle, no words none."""
    hashes = word_hashes([(t or "").encode().lower() for t in texts])
    return [np.unique(runs(h, min(WORDS, max(1, len(h))))) for h in hashes]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of every hash function over the set, as unsigned 32-bit integers."""
    x = shingles >> np.uint64(32)
    low = np.full(_N, np.iinfo(np.uint64).max)
    for i in range(0, len(x), 1024):
        h = x[i : i + 1024, None] * _FACTOR
        h += _TERM
        np.minimum(low, h.min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key of the minima of each band, different from band to band."""
    return mixed((low.reshape(BANDS, ROWS).astype(np.uint64) * _FOLD).sum(1) + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, version, n_shingles, print, bands, marks): a fingerprint of the shingle set, its band keys and signature.

    Sets without shingles have no fingerprint; those too small for a link to another set no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                sets = shingle_sets(part.column("text").to_pylist())
                low = [minima(s) if len(s) >= LEAST else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("version"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([None if x is None else band_keys(x) for x in low], pa.list_(pa.int64())),
                        pa.array([None if x is None else x.astype(np.uint8).tobytes() for x in low], pa.binary()),
                    ],
                    ["doc_id", "version", "n_shingles", "print", "bands", "marks"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, version long, n_shingles long, print binary, bands array<bigint>, marks binary"
    return docs.select("doc_id", version().alias("version"), "text").mapInArrow(lean(run), schema)


def _promising(first_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of each cell whose signatures let a link with another member be; of pairs that meet in more bands the first counts."""
        for table in by_cell(batches):
            marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(-1, _N)
            bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            sizes, sides, band = (table.column(c).to_numpy() for c in ("n_shingles", "side", "band"))
            keep = np.zeros(len(table), bool)
            for start, stop in cells_of(table):
                i, j = all_pairs(sides[start:stop])
                size, own, keys = sizes[start:stop], marks[start:stop], bands[start:stop]
                could = 100 * np.minimum(size[i], size[j]) >= PERCENT * np.maximum(size[i], size[j])
                i, j = i[could], j[could]
                for k in range(0, len(i), 8192):
                    a, b = i[k : k + 8192], j[k : k + 8192]
                    alike = (own[a] == own[b]).mean(1) >= PERCENT / 100 - SLACK
                    a, b = a[alike], b[alike]
                    if first_only:
                        here = (keys[a] == keys[b]).argmax(1) == band[start]
                        a, b = a[here], b[here]
                    keep[start + a] = keep[start + b] = True
            yield from table.filter(pa.array(keep)).select(["cell", "side", "print"]).combine_chunks().to_batches()

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): each member and the first of those that links inside its cell connect with it."""
    for table in by_cell(batches):
        prints, sides = table.column("print").to_pylist(), table.column("side").to_numpy()
        for start, stop in cells_of(table):
            if stop - start < 2:
                continue
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles").slice(start, stop - start)]
            both, size = intersections(sets), np.array(list(map(len, sets)))
            i, j = all_pairs(sides[start:stop])
            shared = both[i, j].astype(np.int64)
            linked = 100 * shared >= PERCENT * (size[i] + size[j] - shared)
            root = joined(stop - start, i[linked], j[linked])
            at = np.flatnonzero(root != np.arange(stop - start))
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([prints[start + k] for k in at], pa.binary()), pa.array([prints[start + k] for k in root[at]], pa.binary())], ["a", "b"]
                )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            sets = [s.tobytes() for s in shingle_sets(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("print"), pa.array(sets, pa.binary())], ["print", "shingles"])


def _links(docs: DataFrame, seen: DataFrame, classes: DataFrame, placed: DataFrame, first_only: bool) -> DataFrame:
    """(a, b) links, as stars inside the cells of `placed`: (cell, side, band, print)."""
    members = placed.join(classes, "print").select("cell", "side", "band", "print", "n_shingles", "bands", "marks")
    kept = stored(members.repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(_promising(first_only)), "cell long, side int, print binary"))
    # one row of each class gives its text
    wanted = kept.select("print").distinct().join(seen.select("print", "doc_id", "version"), "print").dropDuplicates(["print"])
    texts = docs.select("doc_id", version().alias("version"), "text")
    wanted = side_of(stored(wanted.select("print", F.col("doc_id").alias("own_id"), F.col("version").alias("own_version"))))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("version") == F.col("own_version"))).select("print", "text")
    sets = texts.mapInArrow(lean(_sets), "print binary, shingles binary").dropDuplicates(["print"])
    full = kept.join(sets, "print").select("cell", "side", "print", "shingles").repartition("cell").sortWithinPartitions("cell")
    return stored(full.mapInArrow(lean(_settle), "a binary, b binary"))


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("print"), F.greatest(blocks, F.lit(1))).cast("int")


def _triangle(rows: DataFrame, n: str) -> DataFrame:
    """Buckets of `n` rows dealt to pairs of blocks: of a cell with sides 0 and 1 only pairs across are compared, of side -1 all."""
    blocks = F.ceil(F.col(n) / SMALL).cast("int")
    own = _block(blocks)
    cells = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda b: F.struct(
            F.xxhash64(F.col("key"), F.lit(0), F.least(own, b), F.greatest(own, b)).alias("cell"), F.when(own == b, -1).when(own < b, 0).otherwise(1).cast("int").alias("side")
        ),
    )
    return rows.withColumn("c", F.explode(cells)).select("c.cell", "c.side", "band", "print")


def _across(rows: DataFrame, own_n: str, other_n: str, side: int) -> DataFrame:
    """One side of the comparison of two parts of a bucket, each in blocks."""
    own, others = _block(F.ceil(F.col(own_n) / SMALL)), F.ceil(F.col(other_n) / SMALL).cast("int")
    place = (lambda b: (own, b)) if side == 0 else (lambda b: (b, own))
    cells = F.transform(F.sequence(F.lit(0), others - 1), lambda b: F.xxhash64(F.col("key"), F.lit(1), *place(b)))
    return rows.where(F.col(other_n) > 0).withColumn("cell", F.explode(cells)).select("cell", F.lit(side).alias("side"), "band", "print")


def _large_buckets(docs: DataFrame, seen: DataFrame, classes: DataFrame, large: DataFrame) -> DataFrame:
    """The links of buckets beyond `SMALL`: along a star first, then of the strays with all."""
    leads = stored(large.groupBy("key").agg(F.min("print").alias("lead"), F.count("*").alias("n")))
    led = stored(join_counted(large.drop("n"), leads, "key"))
    rest = led.where("print <> lead")
    one = leads.join(large.select("key", "band").distinct(), "key").select("key", "band", F.col("lead").alias("print"), F.lit(1).alias("one"), "n")
    star = _across(rest.withColumn("one", F.lit(1)), "n", "one", 1).unionByName(_across(one, "one", "n", 0))
    first = _links(docs, seen, classes, star, first_only=False)
    groups = stored(components(first))
    label = groups.withColumnRenamed("node", "print")
    own = led.join(label, "print", "left").withColumn("component", F.coalesce("component", "print"))
    lead_label = leads.join(label.select(F.col("print").alias("lead"), F.col("component").alias("main")), "lead", "left").select("key", F.coalesce("main", "lead").alias("main"), "n")
    own = stored(join_counted(own.drop("n"), stored(lead_label), "key").withColumn("stray", F.col("component") != F.col("main")))
    parts = stored(own.groupBy("key").agg(F.count("*").alias("n"), F.count_if("stray").alias("strays"), F.count_if(~F.col("stray")).alias("mains")).where("strays > 0"))
    rows = join_counted(own.drop("n"), parts, "key").where("strays > 0")
    strays, mains = rows.where("stray"), rows.where("NOT stray")
    cells = _triangle(strays, "strays").unionByName(_across(strays, "strays", "mains", 0)).unionByName(_across(mains, "mains", "strays", 1))
    return first.unionByName(_links(docs, seen, classes, stored(cells), first_only=True))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept).

    A-Z are lower-cased; words are what ASCII white space parts. Documents are linked if their sets of five-word shingles share at
    least 85 of 100 of their union. `component_id` is the smallest doc_id that links reach, the document's own included; the document that
    it names is kept.

    Defined cases: one to four words are one shingle; null, empty and blank texts have none, are linked with nothing
    and kept; rows that repeat have equal sets, so they are of one component, and those with its smallest doc_id are all kept;
    rows with one doc_id and different texts are told apart; a row without a doc_id takes part and is kept only where no row of its
    component has a doc_id, which is null then; other columns are ignored; no rows give no rows. Sets are held as 64-bit hashes of
    shingles, and equal sets known by 128 bits.
    """
    seen = stored(signed(docs))
    classes = stored(seen.where("bands IS NOT NULL").select("print", "n_shingles", "bands", "marks").dropDuplicates(["print"]))
    level = classes.select("print", F.posexplode("bands").alias("band", "key"))
    # stored in between, so that the join is a stage of its own and a large bucket can be split
    counts = stored(level.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = stored(level.join(counts, "key"))
    small = members.where(F.col("n") <= SMALL).select(F.col("key").alias("cell"), F.lit(-1).alias("side"), "band", "print")
    links = _links(docs, seen, classes, small, first_only=True)
    large = members.where(F.col("n") > SMALL)
    if not large.isEmpty():
        links = links.unionByName(_large_buckets(docs, seen, classes, large))
    groups = components(links)

    prints = seen.where("print IS NOT NULL").groupBy("print").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    named = stored(prints.join(groups.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print")))
    least = stored(named.groupBy("component").agg(F.count("*").alias("n"), F.min("first").alias("component_id")))
    facts = stored(join_counted(named.withColumnRenamed("n", "rows"), least, "component").where("rows > 1 OR n > 1").select("print", F.col("rows").alias("n"), "component_id", F.lit(True).alias("known")))
    out = join_counted(seen.select("doc_id", "n_shingles", "print"), facts, "print")
    out = out.withColumn("component_id", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
