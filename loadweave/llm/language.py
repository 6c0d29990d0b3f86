"""Language identification by unigram models that sum over all segmentations.

The pieces are those of a fixed public vocabulary (a sentencepiece file whose path is a parameter).
Each language has a probability for every piece. The probability of a word is the sum over all
ways to cut it into pieces, found by the forward algorithm; a text is the product of its words.
The piece probabilities are learned by expectation maximisation: the expected number of
uses of each piece over all segmentations of the training words, by a forward and a backward pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from loadweave.llm.common import bounded_side, stored, values
from loadweave.llm.sampling import held_out, sample_of_each

#: Documents of each language that the model learns from at most
MAX_ROWS = 6_000
#: Rows up to which the sample is broadcast: a document id and a language each
SIDE_ROWS = 1_000_000
ROUNDS = 2
UNKNOWN = "und"
#: Longer runs of letters are scored in stretches of this length
LONGEST = 48
WORDS_KEPT = 300_000
#: Scales each letter's probability, so that long words stay within the range of doubles
SCALE = 64.0
#: Probability of a letter that no piece covers
STRAY = 1e-7
#: Added to each piece's expected count
SMOOTHING = 0.05

#: Letters with the marks that follow them
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: A letter, for Spark
_ANY_LETTER = r"\p{L}"
_START = "▁"


def words_of(text: str) -> list[str]:
    """The text's runs of letters in lower case, long ones in stretches."""
    found = _LETTERS.findall(text.lower())
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]


class Pieces:
    """The vocabulary as an automaton that finds every piece inside many words at once."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = dict.fromkeys(sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        self.names = [n for n in names if len(n) <= LONGEST + 1]
        # a number for each piece, so that the hits become an array without a Python object of their own
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.sizes = np.array([len(n) for n in self.names], np.int64)
        for i, name in enumerate(self.names):
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()

    def lattice(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Every piece in every word as an edge: (word, start, end, piece), ordered by end, then word.

        Positions count from the mark that starts a word. A letter without a piece of its own gets an edge of piece -1.
        """
        joined = "\n".join(_START + w for w in words) + "\n"
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        offsets = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        end, piece = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2).T
        size = self.sizes[piece]
        alone = np.zeros(len(joined), bool)
        alone[end[size == 1]] = True
        alone[offsets + sizes] = True
        stray = np.flatnonzero(~alone)
        end, piece, size = np.concatenate([end, stray]), np.concatenate([piece, np.full(len(stray), -1)]), np.concatenate([size, np.ones(len(stray), np.int64)])
        word = np.searchsorted(offsets, end, side="right") - 1
        stop = end - offsets[word] + 1
        order = np.lexsort((word, stop))
        return word[order], (stop - size)[order], stop[order], piece[order], sizes

    def forward(self, words: list[str], chances: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
        """Scaled sums over all segmentations of each prefix, for each row of `chances` (pieces x languages)."""
        edges = word, start, stop, piece, sizes = self.lattice(words)
        # row -1 is the stray letter
        p = chances[piece] * (SCALE ** (stop - start))[:, None]
        alpha = np.zeros((int(sizes.max(initial=0)) + 1, len(words), chances.shape[1]))
        alpha[0] = 1
        bounds = np.searchsorted(stop, np.arange(len(alpha) + 1))
        for t in range(1, len(alpha)):
            part = slice(bounds[t], bounds[t + 1])
            w = word[part]
            if len(w):
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                alpha[t, w[first]] = np.add.reduceat(alpha[start[part], w] * p[part], first, axis=0)
        return alpha, edges, p

    def log_chances(self, words: list[str], chances: np.ndarray) -> np.ndarray:
        """log P(word) for each word and language."""
        alpha, (_, _, _, _, sizes), _ = self.forward(words, chances)
        return np.log(alpha[sizes, np.arange(len(words))]) - sizes[:, None] * np.log(SCALE)

    def expected(self, words: list[str], counts: np.ndarray, chances: np.ndarray) -> np.ndarray:
        """Expected uses of each piece for one language, over all segmentations of the counted words."""
        alpha, (word, start, stop, piece, sizes), p = self.forward(words, chances)
        alpha, p = alpha[:, :, 0], p[:, 0]
        beta = np.zeros_like(alpha)
        beta[sizes, np.arange(len(words))] = 1
        order = np.lexsort((word, start))
        bounds = np.searchsorted(start[order], np.arange(len(alpha) + 1))
        for t in range(len(alpha) - 2, -1, -1):
            e = order[bounds[t] : bounds[t + 1]]
            np.add.at(beta[t], word[e], p[e] * beta[stop[e], word[e]])
        used = alpha[start, word] * p * beta[stop, word] * (counts / alpha[sizes, np.arange(len(words))])[word]
        known = piece >= 0
        return np.bincount(piece[known], used[known], len(self.names))


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def fit(docs: DataFrame, path: str, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-free piece probabilities with the stray row last), learned from at most `max_rows` documents of each language.

    The documents are outside fold 0 and have a language and a text with a letter; every language with such a document
    is in the model, with all documents of a rarer one. What comes to the driver is the model:
    a number for each piece and language.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(_ANY_LETTER) & ~held_out()).select("doc_id", "lang")
    sample = bounded_side(sample_of_each(usable.distinct(), "lang", max_rows), SIDE_ROWS)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(values(batch.column("lang")), values(batch.column("text"))):
                word, n = np.unique(np.array(words_of(text), object), return_counts=True)
                if len(word):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(word)), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    rows = docs.select("doc_id", "lang", "text").join(sample, ["doc_id", "lang"]).select("lang", "text")
    counted = stored(rows.mapInArrow(split, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    size = len(pieces(path).names)
    # before the first round: pieces come in the order of their use in the vocabulary's own corpus
    chances = np.repeat((1 / (np.arange(size) + 10.0))[:, None], len(langs), axis=1)
    for _ in range(ROUNDS if langs else 0):
        chances = np.vstack([chances / chances.sum(0), np.full(len(langs), STRAY)])

        def expect(batches: Iterator[pd.DataFrame], chances: np.ndarray = chances) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(langs), size))
            for batch in batches:
                for i, lang in enumerate(langs):
                    part = batch[batch["lang"] == lang]
                    for k in range(0, len(part), 5_000):
                        some = part.iloc[k : k + 5_000]
                        total[i] += pieces(path).expected(some["word"].tolist(), some["n"].to_numpy(float), chances[:, i : i + 1])
            lang, piece = np.nonzero(total)
            yield pd.DataFrame({"lang": lang, "piece": piece, "n": total[lang, piece]})

        got = counted.mapInPandas(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        chances = np.full((size, len(langs)), SMOOTHING)
        chances[got["piece"].to_numpy(int), got["lang"].to_numpy(int)] += got["n"].to_numpy()
    return langs, np.vstack([chances / chances.sum(0), np.full(len(langs), STRAY)])


class _Scores:
    """Remembers each word's log-probabilities; forgets all when full."""

    def __init__(self, path: str, chances: np.ndarray):
        self.path, self.chances, self.rows = path, chances, {}
        self.table = np.zeros((WORDS_KEPT, chances.shape[1]))

    def total(self, texts: list[list[str]]) -> np.ndarray:
        """The summed log-probabilities of each list of words."""
        fresh = list(set().union(*texts).difference(self.rows))
        if len(self.rows) + len(fresh) > WORDS_KEPT:
            self.rows, fresh = {}, list(set().union(*texts))
        for i in range(0, len(fresh), 5_000):
            some = fresh[i : i + 5_000]
            at = len(self.rows)
            self.table[at : at + len(some)] = pieces(self.path).log_chances(some, self.chances)
            self.rows.update(zip(some, range(at, at + len(some))))
        return np.array([self.table[np.fromiter(map(self.rows.__getitem__, t), np.int64, len(t))].sum(0) for t in texts])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str) -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language of every whole text and its share of all languages' likelihood.

    Defined cases: a null or empty text, or one without a letter, is `und` with score 0, and so is every text if
    there was nothing to learn from; of equal likelihoods the language first in the alphabet is taken; rows that
    repeat come out as often; a null doc_id stays null; other columns are ignored.
    """
    langs, chances = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(path, chances) if langs else None
        for batch in batches:
            names, sure = [], []
            for found in _portions(values(batch.column("text"))):
                total = np.zeros((len(found), max(1, len(langs))))
                for row, parts in enumerate(found):
                    for part in parts[1:]:
                        total[row] += scores.total([part])[0] if langs else 0
                if langs:
                    total += scores.total([p[0] for p in found])
                share = np.exp(total - total.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                best = share.argmax(1)
                for parts, b, s in zip(found, best.tolist(), share.max(1).tolist()):
                    known = langs and parts[0]
                    names.append(langs[b] if known else UNKNOWN)
                    sure.append(s if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


_CURRENT: list = [None, None]


def _scores(path: str, chances: np.ndarray) -> _Scores:
    """The worker's word memory, kept from task to task while the model is the same."""
    key = path, chances.tobytes()
    if _CURRENT[0] != key:
        _CURRENT[:] = key, _Scores(path, chances)
    return _CURRENT[1]


def _portions(texts: Iterator[str | None], size: int = 20_000) -> Iterator[list[list[list[str]]]]:
    """Texts in groups of about `size` words; each text is a list of portions of at most that many words."""
    group, n = [], 0
    for text in texts:
        words = words_of(text or "")
        group.append([words[i : i + size] for i in range(0, max(1, len(words)), size)])
        n += len(words)
        if n >= size:
            yield group
            group, n = [], 0
    if group:
        yield group


def language(docs: DataFrame, path: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """One row per document: (doc_id, held_out, lang_pred, score); see `predict` for the defined cases."""
    found = predict(docs, fit(docs, path, max_rows), path)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
