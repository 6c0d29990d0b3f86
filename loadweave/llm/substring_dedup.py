"""Removal of passages that occur earlier: recurring phrases, automata per shard, exact windows.

A window is `WINDOW` consecutive words. Each window names one phrase of `PHRASE` words inside it, the one
with the smallest hash, so equal windows name equal phrases (winnowing). Phrases named in two
places or more recur. Documents are dealt to shards of about `SHARD_BYTES` of text; each shard gets
the hashes of its recurring phrases, confirms them as words and compiles them into an Aho-Corasick
automaton, through which its documents are streamed to locate every occurrence. The windows around
the occurrences are then settled by 128-bit hashes over all shards: each distinct window is
spared at its first place, and covers its words everywhere else.

Texts that are copies of another as a whole are settled by their digest and take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loadweave.llm.common import bounded_side, stored, version, whole
from loadweave.llm.words import mixed, runs, word_hashes

WINDOW = 20
PHRASE = 6
#: Text of a shard
SHARD_BYTES = 4 << 20
#: Rows up to which the ids of copies are broadcast: 16 bytes each
SIDE_ROWS = 1_000_000

_STEPS = WINDOW - PHRASE + 1


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def among(found: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Which of the values are among the sorted ones."""
    if not len(sought):
        return np.zeros(len(found), bool)
    return sought[np.minimum(np.searchsorted(sought, found), len(sought) - 1)] == found


def _phrases(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all phrases, and for each window the place of the phrase it names."""
    g = runs(h, PHRASE)
    if len(g) < _STEPS:
        return g, np.zeros(0, np.int64)
    return g, np.lib.stride_tricks.sliding_window_view(g, _STEPS).argmin(1) + np.arange(len(g) - _STEPS + 1)


def _places(named: np.ndarray) -> np.ndarray:
    """The places that any window names, once each. Equal windows at two places name two, also in one text."""
    return named[np.flatnonzero(np.r_[True, named[1:] != named[:-1]])] if len(named) else named


def _named(docs: DataFrame) -> DataFrame:
    """(phrase, shard, places): the phrases that windows name, with up to two places each, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                found = []
                for h in word_hashes([_utf8(t) for t in part.column("text").to_pylist()]):
                    g, named = _phrases(h)
                    found.append(g[_places(named)])
                phrase, shard = np.concatenate(found), np.repeat(part.column("shard").to_numpy(), list(map(len, found)))
                order = np.lexsort((phrase, shard))
                phrase, shard = phrase[order], shard[order]
                first = np.flatnonzero(np.r_[True, (phrase[1:] != phrase[:-1]) | (shard[1:] != shard[:-1])][: len(phrase)])
                places = np.minimum(np.diff(np.r_[first, len(phrase)]), 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(phrase[first].view(np.int64)), pa.array(shard[first]), pa.array(places)], ["phrase", "shard", "places"]
                )

    return docs.select("shard", "text").mapInArrow(run, "phrase long, shard long, places long")


class Shard:
    """The automaton of a shard's recurring phrases, over the words that occur in them."""

    def __init__(self, texts: list[np.ndarray], recurring: np.ndarray):
        """`texts` are word hashes; `recurring` the sorted hashes of the phrases that recur."""
        found: dict[int, np.ndarray] = {}
        self.texts: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]] = []
        for h in texts:
            g, named = _phrases(h)
            places = _places(named)
            places = places[among(g[places], recurring)]
            self.texts.append((h, g, named, len(places) > 0))
            for at in places.tolist():
                found.setdefault(int(g[at]), h[at : at + PHRASE])
        self.words = np.unique(np.concatenate([*found.values(), np.zeros(0, np.uint64)]))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, words in found.items():
            self.automaton.add_word(tuple((np.searchsorted(self.words, words) + 1).tolist()), phrase)
        if found:
            self.automaton.make_automaton()

    def windows(self, text: int) -> np.ndarray:
        """The starts of the windows that name a recurring phrase, from the places where the automaton meets it."""
        h, g, named, names_any = self.texts[text]
        if not names_any:
            return np.zeros(0, np.int64)
        # a word of no phrase is letter 0, which the automaton does not know
        letters = np.where(among(h, self.words), np.searchsorted(self.words, h) + 1, 0)
        met = list(self.automaton.iter(tuple(letters.tolist())))
        if not met:
            return np.zeros(0, np.int64)
        ends, phrases = zip(*met)
        first, phrase = np.array(ends, np.int64) - PHRASE + 1, np.array(phrases, np.uint64)
        by_window = g[named]
        at = first[:, None] - np.arange(_STEPS)
        inside = (at >= 0) & (at < len(named))
        holds = inside & (by_window[np.clip(at, 0, len(named) - 1)] == phrase[:, None])
        return np.unique(at[holds])


def _window_hashes(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each of the windows."""
    first = runs(h, WINDOW)[at]
    second = runs(mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), WINDOW, 0xD6E8FEB86659FD93)[at]
    return first.view(np.int64), second.view(np.int64)


def _stretches(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive numbers as (start, stop) of their stretches."""
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + 1


def _key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for a window among those of one shard or document."""
    return first ^ second


def _located(docs: pd.DataFrame, recurring: pd.DataFrame) -> pd.DataFrame:
    """One row per row with candidate windows: their stretches, and the hashes of those that come first in the shard."""
    columns = ["doc_id", "version", "starts", "stops", "first", "second"]
    if docs.empty or recurring.empty:
        return pd.DataFrame(columns=columns)
    docs = docs.sort_values("doc_id", kind="stable")
    shard = Shard(word_hashes([_utf8(t) for t in docs["text"]]), np.unique(recurring["phrase"].to_numpy(np.int64).view(np.uint64)))
    ids = enumerate(zip(docs["doc_id"], docs["version"]))
    found = [(row, at, *_window_hashes(shard.texts[i][0], at)) for i, row in ids if len(at := shard.windows(i))]
    if not found:
        return pd.DataFrame(columns=columns)
    keys = _key(np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found]))
    lead = np.zeros(len(keys), bool)
    lead[np.unique(keys, return_index=True)[1]] = True
    rows = []
    for (row, at, first, second), here in zip(found, np.split(lead, np.cumsum([len(f[1]) for f in found])[:-1])):
        rows.append((*row, *_stretches(at), first[here], second[here]))
    return pd.DataFrame(rows, columns=columns)


def _spared(words: list[bytes], row_starts: np.ndarray, row_stops: np.ndarray, spared: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which words a later window covers. Only a window's first place in the document can be the first of all."""
    at = np.unique(np.concatenate([np.arange(a, b) for a, b in zip(row_starts, row_stops)]))
    keys, place = np.unique(_key(*_window_hashes(h, at)), return_index=True)
    later = np.ones(len(at), bool)
    later[place[among(keys, np.sort(spared))]] = False
    edge = np.bincount(at[later], minlength=len(words) + 1) - np.bincount(at[later] + WINDOW, minlength=len(words) + 1)
    return np.cumsum(edge)[:-1] > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 200):
            part = batch.slice(i, 200)
            counts, removed, kept = [], [], []
            texts = [_utf8(t) for t in part.column("text").to_pylist()]
            marked = [t if s else b"" for t, s in zip(texts, part.column("starts").is_valid().to_pylist())]
            for text, h, copy, *judged in zip(texts, word_hashes(marked), *(part.column(c) for c in ("copy", "starts", "stops", "spared"))):
                words = text.split()
                lost = np.zeros(len(words), bool)
                if copy.as_py():
                    lost[:] = len(words) >= WINDOW
                elif judged[0].is_valid:
                    starts, stops, spared = (x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64) for x in judged)
                    lost = _spared(words, starts, stops, spared, h)
                counts.append(len(words))
                removed.append(int(lost.sum()))
                kept.append(b" ".join(words if not removed[-1] else [w for w, gone in zip(words, lost.tolist()) if not gone]))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_words, n_removed, kept); `kept` is the UTF-8 of the words left, joined by spaces.

    Every word goes that lies in a window whose words also start at an earlier place: in a smaller doc_id, or
    earlier in the same document. Windows are judged on the input. Two windows count as equal when their 128-bit
    hashes are.

    Defined cases: null and empty texts have no words; texts shorter than a window keep all words; rows that repeat
    a doc_id count as one document, whose windows are spared at their first place in each of its rows; a row without a doc_id keeps its words
    and makes no other lose any; other columns are ignored; no rows give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").withColumn("version", version())
    digests = stored(rows.where("doc_id IS NOT NULL").select("doc_id", "version", F.sha2(whole("text"), 256).alias("digest"), F.octet_length(whole("text")).alias("bytes")))
    shards = max(1, math.ceil((digests.agg(F.sum("bytes")).first()[0] or 0) / SHARD_BYTES))
    # partial sums first, so a text that a third of the rows share is one row per task
    groups = stored(digests.groupBy("digest").agg(F.min("doc_id").alias("original"), F.count("*").alias("n")).where("n > 1"))
    copies = stored(digests.join(groups, "digest").where("doc_id <> original").select("doc_id", "version").distinct().withColumn("copy", F.lit(True)))
    lone = rows.where("doc_id IS NOT NULL").join(bounded_side(copies, SIDE_ROWS), ["doc_id", "version"], "left_anti").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))

    named = stored(_named(lone))
    often = stored(named.groupBy("phrase").agg(F.sum("places").alias("places")).where("places > 1").select("phrase"))
    recurring = named.select("phrase", "shard").join(often, "phrase").distinct()
    found = lone.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInPandas(_located, f"doc_id {kind}, version long, starts array<int>, stops array<int>, first array<long>, second array<long>")
    found = stored(found)

    windows = found.select("doc_id", F.explode(F.arrays_zip("first", "second")).alias("w")).select("doc_id", "w.*")
    spared = windows.groupBy("first", "second").agg(F.min("doc_id").alias("doc_id"))
    # as `_key`
    spared = spared.select("doc_id", F.col("first").bitwiseXOR(F.col("second")).alias("key")).groupBy("doc_id").agg(F.collect_list("key").alias("spared"))
    places = found.select("doc_id", "version", "starts", "stops").groupBy("doc_id", "version").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("stops")).alias("stops"))
    judged = places.join(spared, "doc_id", "left").unionByName(copies, allowMissingColumns=True)
    judged = stored(judged)
    ids = stored(judged.select("doc_id", "version").distinct())
    if ids.count() <= SIDE_ROWS:
        # only the texts that lose words are shuffled
        held = rows.join(F.broadcast(ids), ["doc_id", "version"], "left_semi").join(judged, ["doc_id", "version"])
        held = held.unionByName(rows.join(F.broadcast(ids), ["doc_id", "version"], "left_anti"), allowMissingColumns=True)
    else:
        held = rows.join(judged, ["doc_id", "version"], "left")
    return held.select("doc_id", "text", "copy", "starts", "stops", "spared").mapInArrow(_kept, f"doc_id {kind}, n_words long, n_removed long, kept binary")
