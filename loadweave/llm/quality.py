"""Quality scores: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text is a sequence of words and of runs of marks. Its features are hashed unigrams and bigrams
of the words and of their shapes (letter case, digits, the mark run itself, a repeat of the
word before), so that words never seen in training count as well. Counts are scaled to unit
length; a score is a sparse dot product with the weights. Training runs in `SHARDS` tasks over
a bounded sample of the labelled rows; the weights are averaged.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadweave.llm.common import lean, values
from loadweave.llm.sampling import bounded_sample, held_out

BITS = 18
SHARDS = 4
#: Updates that a task makes at least; few labelled rows are gone through more often
UPDATES = 9_000
#: Labelled rows that the model learns from at most
MAX_ROWS = 12_000
THRESHOLD = 0.3
#: Words remembered by one task; beyond that the memory starts anew
WORDS_KEPT = 200_000
#: Words of a text that are turned into features at a time
PORTION = 100_000

_WORD = re.compile(r"\w+|[^\w\s]+")
_SIZE = 1 << BITS
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: str) -> str:
    if word.isalpha():
        return "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "a"
    return "0" if word.isdigit() else "w" if word[0].isalnum() else word[:4]


class _Words(dict):
    """Word -> (hash of the lower-cased word, hash of its shape), as one number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        code = zlib.crc32(word.lower().encode()) << 32 | zlib.crc32(_shape(word).encode(), 7)
        self[word] = code
        return code


def _slots(a: np.ndarray, salt: int, b: np.ndarray | None = None) -> np.ndarray:
    h = a.astype(np.uint64) + np.uint64(salt) * np.uint64(0x1000193)
    with np.errstate(over="ignore"):
        h = h * _MULTIPLIER
        if b is not None:
            h = ((h ^ (h >> np.uint64(31))) + b) * _MULTIPLIER
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str, known: _Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The text's feature slots and their values, of unit length; none for a text without words.

    `known` remembers words from text to text. It belongs to a task, so that idle workers hold no memory.
    """
    known = _Words() if known is None else known
    found: list[np.ndarray] = []
    words = _WORD.findall(text)
    for i in range(0, len(words), PORTION):
        # two words of overlap: one for the bigram across portions, one to tell whether its first word is a repeat
        over = min(i, 2)
        codes = np.fromiter(map(known.__getitem__, words[i - over : i + PORTION]), np.uint64)
        word, shape = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
        same = np.zeros(len(codes), np.uint64)
        same[1:] = word[1:] == word[:-1]
        shape = shape * np.uint64(2) + same
        b = slice(max(0, over - 1), None)
        found += [_slots(word[over:], 1), _slots(shape[over:], 2), _slots(word[b][:-1], 3, word[b][1:]), _slots(shape[b][:-1], 4, shape[b][1:])]
    if not found:
        return np.zeros(0, np.int32), np.zeros(0)
    slots, counts = np.unique(np.concatenate(found), return_counts=True)
    # square roots keep one word that fills a text from hiding all others
    x = np.sqrt(counts)
    return slots, x / np.sqrt((x * x).sum())


def train(examples: list[tuple[np.ndarray, np.ndarray, float]], updates: int = UPDATES, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002) -> tuple[np.ndarray, float]:
    """FTRL-proximal logistic regression; returns the weights and the intercept, which is slot `_SIZE`."""
    z, n = np.zeros(_SIZE + 1), np.zeros(_SIZE + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(math.ceil(updates / max(1, len(examples)))):
        for slots, x, y in examples:
            at, v = np.append(slots, _SIZE), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            grown = np.sqrt(n[at] + g * g)
            z[at] += g - (grown - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(_SIZE + 1))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Weights and intercept learned from at most `max_rows` labelled documents outside fold 0.

    A document labelled more than once takes its largest label. Without any label the score is 0.5 throughout.
    """
    usable = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # the bound of the sample is the bound of the broadcast
    sample = F.broadcast(bounded_sample(usable, max_rows))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "doc_id"])
        known = _Words()
        w, bias = train([(*features(t or "", known), float(q)) for t, q in zip(part["text"], part["quality"])])
        at = np.flatnonzero(w)
        return pd.DataFrame({"slot": np.append(at, _SIZE), "weight": np.append(w[at], bias)})

    rows = docs.select("doc_id", "text").join(sample, "doc_id").withColumns({"order": F.xxhash64("doc_id"), "shard": F.pmod(F.hash("doc_id"), F.lit(SHARDS))})
    parts = rows.groupBy("shard").applyInPandas(learn, "slot int, weight double")
    # a shard without a weight for a slot has zero there; at most 2**BITS + 1 rows come back
    got = parts.groupBy("slot").agg(F.sum("weight").alias("weight"), F.count("*").alias("shards")).toPandas()
    w = np.zeros(_SIZE + 1)
    trained = got.loc[got["slot"] == _SIZE, "shards"].max() if len(got) else 1
    w[got["slot"].to_numpy(int)] = got["weight"].to_numpy() / trained
    return w[:-1].astype(np.float32), float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], out: str = "score") -> DataFrame:
    """Every row of `docs` with one more column, `out` (0 to 1), whose name must be free."""
    w, bias = model
    columns = list(docs.columns)
    if out in columns:
        raise ValueError(f"there is a column {out} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part, found = batch.slice(i, 1000), []
                for text in values(part.column("text")):
                    slots, x = features(text or "", known)
                    found.append(1 / (1 + np.exp(-np.clip(float(w[slots] @ x) + bias, -35, 35))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*columns, out])

    return docs.mapInArrow(lean(run), f"{docs._jdf.schema().toDDL()}, `{out}` double")


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted).

    Defined cases: null and empty texts have no features and take the intercept's score; rows that repeat
    come out as often; a row without a doc_id is scored and counts as held out; columns of the labels table
    other than doc_id and quality are ignored; without labels every score is 0.5.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, max_rows))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
