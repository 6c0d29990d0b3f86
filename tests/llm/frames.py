"""Small documents for the tests of the text operators."""

from __future__ import annotations

import random

#: Extra columns, some named like what the operators use inside
EXTRA = ["batch", "shard", "node", "rep", "tokens", "key", "at", "lines", "body", "digest", "size", "score", "copy", "TEXT_", "print", "__score", "__text", "version", "first", "members", "class", "hash", "part", "n"]

WORDS = "and the of river stone light under winter garden bridge lantern forest harbour quiet morning copper silver road".split()


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    """A documents frame from (doc_id, text[, lang]) rows, with columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, schema)
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit("x") for name in EXTRA})


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + (rnd.choice(WORDS) if rnd.random() < 0.7 else "") for _ in range(n))


def odd_rows():
    """Nulls, empties, blanks, repeated rows, ties and a very long text."""
    long = prose(99, 30_000)
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two three"), (5, "One Two three"), (6, prose(1, 80)), (7, prose(1, 80)),
        (7, prose(1, 80)), (8, long), (9, long + " tail"), (10, "Ünïcode ÄÖ ßß 中文 😀 \x00 end"), (11, "the " * 200), (12, "\n" * 50), (None, prose(1, 80)), (None, None),
    ]


def by_id(df, *columns):
    """{doc_id: rows as tuples} of a result."""
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns))
    return out
