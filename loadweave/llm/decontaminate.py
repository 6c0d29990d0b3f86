"""Benchmark items inside documents: MinHash containment search in size partitions, then exact shingles.

The sketch of a document is a one-permutation MinHash: the range of a hash is cut into bins and
each bin keeps its smallest shingle hash. The number of bins follows the size partition of the document
(powers of two), so a shingle of a long document survives as often as one of a short document, and
a short item inside a long document keeps its chance to be found, which a sketch of
fixed size would not give. An item that shares m shingles with a document is missed only if all m
are displaced; bins are added until the smallest item's chance of that is below `MISS`.

A document with any sketch hash among an item's shingles is a candidate. For candidates the exact
containment is counted: the share of the item's distinct five-word shingles that the document has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from loadweave.llm.common import bounded_side, let, stored, whole, word_array

WORDS = 5
CONTAINED = 0.8
#: Chance that all shared shingles of the smallest item are displaced
MISS = 1e-5
#: Rows up to which shingles of items (a hash and an id) and ids of candidates are broadcast
SIDE_ROWS = 1_000_000


def _runs(words: Column, length: int | Column, form) -> Column:
    """`form` of every run of so many consecutive words; none if there are fewer."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.when((F.size(words) < n) | (n < 1), F.array()).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: form(F.slice(words, i, n))))


def _hashes(words: Column, length: int) -> Column:
    return _runs(words, length, lambda s: F.xxhash64(s)).cast("array<bigint>")


def _texts(words: Column, length: int | Column) -> Column:
    return F.array_distinct(_runs(words, length, lambda s: F.array_join(s, " ")).cast("array<string>"))


def bins_per_shingle(smallest: int) -> int | None:
    """The least power of two of bins for each shingle that keeps MISS; None if only all shingles would."""
    for power in range(0, 5):
        load = 1 / 2**power
        survives = (1 - math.exp(-load)) / load
        if (1 - survives) ** smallest <= MISS:
            return 2**power
    return None


def _fewest() -> int:
    """The least number of shingles that a sketch keeps well enough."""
    return next(n for n in range(1, 1000) if bins_per_shingle(n) is not None)


def _sketch(hashes: Column, bins: int | None) -> Column:
    """The smallest hash of each bin. The number of bins is that of the size partition times `bins`."""
    if bins is None:
        return F.array_distinct(hashes)

    def of(h: Column) -> Column:
        # the size partition: the power of two at or above the number of shingles
        bits = F.ceil(F.log2(F.greatest(F.size(h), F.lit(2)))).cast("int") + int(math.log2(bins))
        return let(
            F.struct(F.sort_array(h).alias("h"), (F.lit(64) - bits).alias("shift")),
            lambda s: F.filter(s["h"], lambda x, i: (i == 0) | (F.call_function("shiftright", x, s["shift"]) != F.call_function("shiftright", F.get(s["h"], i - 1), s["shift"]))),
        )

    return let(hashes, of)


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): every item of which a document has `threshold` of the shingles.

    Shingles are five consecutive words (lower-cased runs of letters and digits), counted once each; an item of one to four words
    is one shingle of all its words, sought as a whole run of words.

    Defined cases: null and empty texts have no shingles and are in no result; rows that repeat an id are one document (or item) with the
    shingles of all of them; rows without an id are ignored; ties cannot occur, all items that reach the threshold are returned; other
    columns are ignored; an empty table on either side gives no rows.
    """
    split = items.where("item_id IS NOT NULL").select("item_id", word_array(whole(items["text"])).alias("words")).withColumn("length", F.least(F.size("words"), F.lit(WORDS)))
    items = split.select("item_id", "length", F.explode(_texts(F.col("words"), F.col("length"))).alias("shingle")).distinct()
    items = stored(items.withColumn("hash", F.xxhash64(F.split("shingle", " "))))
    sizes = items.groupBy("item_id").agg(F.count("*").alias("n_item"), F.min("length").alias("least"))
    # items of so few shingles that a sketch may miss them are sought among all shingles, the others by sketches laid out for the smallest
    few = (F.ceil(threshold * F.col("n_item") - 1e-9) < _fewest()) | (F.col("least") < WORDS)
    classed = stored(items.join(sizes.withColumn("few", few), "item_id").withColumn("class", F.when(F.col("few"), F.col("length")).otherwise(0)))
    smallest = classed.where("NOT few").agg(F.min("n_item")).first()[0]
    bins = None if smallest is None else bins_per_shingle(math.ceil(threshold * smallest - 1e-9))
    classes = sorted(r["class"] for r in classed.select("class").distinct().collect())  # of 0 to WORDS

    def sketches(words: Column) -> Column:
        def of(c: int) -> Column:
            return F.transform(_sketch(_hashes(words, c or WORDS), None if c else bins), lambda h: F.struct(F.lit(c).alias("class"), h.alias("hash")))

        parts = [of(c) for c in classes]
        return F.concat(*parts) if parts else F.array().cast("array<struct<class:int,hash:bigint>>")

    named = docs.where("doc_id IS NOT NULL")
    hashes = named.select("doc_id", F.explode(let(word_array(whole(named["text"])), sketches)).alias("s")).select("doc_id", "s.*")
    sought = bounded_side(stored(classed.select("class", "hash").distinct()), SIDE_ROWS)
    candidates = stored(hashes.join(sought, ["class", "hash"], "left_semi").select("doc_id").distinct())
    near = named.join(bounded_side(candidates, SIDE_ROWS), "doc_id", "left_semi")
    lengths = sorted({c or WORDS for c in classes})

    def texts(words: Column) -> Column:
        return F.concat(*[_texts(words, n) for n in lengths]) if lengths else F.array().cast("array<string>")

    theirs = near.select("doc_id", F.explode(let(word_array(whole(near["text"])), texts)).alias("shingle"))
    known = classed.select("item_id", "n_item", "shingle")
    shared = theirs.join(bounded_side(stored(known), SIDE_ROWS), "shingle").groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("shingle").alias("n_shared"))
    found = shared.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9)
    return found.select("doc_id", "item_id", "n_shared", "n_item", "containment")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = CONTAINED) -> DataFrame:
    """The documents that contain no item; rows without an id stay."""
    leaks = stored(contained_items(docs, items, threshold).select("doc_id").distinct())
    return docs.join(bounded_side(leaks, SIDE_ROWS), "doc_id", "left_anti").select(docs.columns)
