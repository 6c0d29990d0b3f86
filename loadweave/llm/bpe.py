"""Byte-pair encoding by speculation: guess by greedy longest match, check, and merge only what fails.

A guess is the encoding if every token is one that merging its own bytes yields and no merge
would ever cross the boundary of two neighbours. Both are properties of the merge table alone:
the first is worked out once for all tokens, the second for arrays of pairs at a time, by
walking the merge trees of the two neighbours back in time. Words that fail are merged exactly.

The vocabulary file is a `tokenizers` JSON with word ends; its path is a parameter. Letters that only the newest
Unicode versions define may be split from their neighbours differently than by an older library.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loadweave.llm.common import lean, values

#: Words remembered by one task; beyond that the memory starts anew
WORDS_KEPT = 300_000
#: Words looked up together; a text may have more
PORTION = 50_000

#: Fixed values of the file's pre-tokeniser: its white space and the pattern of its words
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+"
END = "</w>"
NEVER = 1 << 62


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Bpe:
    """The vocabulary with its merge trees; encodes and decodes lists of texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.letters = _byte_letters()
        self.translation = str.maketrans({chr(b): c for b, c in enumerate(self.letters)})
        self.vocab = vocab
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = vocab | self.special
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        self.utf8 = [n.encode() for n in self.names]
        self.sizes = np.zeros(len(self.names), np.int64)
        self.automaton = ahocorasick.Automaton()
        for name, i in vocab.items():
            letters = name.removesuffix(END) + "\n" if name.endswith(END) else name
            self.automaton.add_word(letters, i)
            self.sizes[i] = len(letters)
        self.automaton.make_automaton()
        self.word = regex.compile(WORD)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        n = len(self.names)
        self.left, self.right, self.rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.merge: dict[int, int] = {}
        keys = np.empty(len(merges), np.int64)
        made = np.empty(len(merges), np.int64)
        for r, (a, b) in enumerate(merges):
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.merge[a << 20 | b] = r << 20 | c
            keys[r], made[r] = a << 20 | b, r
            self.left[c], self.right[c], self.rank[c] = a, b, r
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], made[order]
        self.sound = self._sound(merges, vocab)
        self.words: dict[str, bytes] = {}
        self.forget()

    def _sound(self, merges: list, vocab: dict[str, int]) -> np.ndarray:
        """Tokens that merging their own bytes yields: both halves are, and nothing crosses before they meet."""
        c = np.array([vocab[a + b] for a, b in merges])
        clear = self.apart(self.left[c], self.right[c], np.arange(len(c)))
        sound = self.rank < 0
        for token, ok in zip(c.tolist(), clear.tolist()):
            sound[token] = ok and sound[self.left[token]] and sound[self.right[token]]
        return sound

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)

    def apart(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours: does no merge cross their boundary (before the given ranks)?

        Going back in time, the one of the two that was made later is undone: `a` leaves its right
        half at the boundary, `b` its left half. A merge of the two at the boundary would have happened
        if it ranks before the undone one. Of two equal merges the left one comes first, so undoing
        `b` lets an equal rank through as well.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), np.iinfo(np.int64).max) if before is None else before.astype(np.int64)
        clear = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y, top = a[live], b[live], limit[live]
            crossed = self._pair_rank(x, y) < top
            clear[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_a = rx > ry
            a[live] = np.where(undo_a, self.right[x], x)
            b[live] = np.where(undo_a | (ry < 0), y, self.left[y])
            limit[live] = np.where(undo_a, rx, ry + 1)
            live = live[~crossed & ((rx >= 0) | (ry >= 0))]
        return clear

    def _guess(self, spelled: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match over all words at once: tokens, the word of each, and which words they cover whole.

        A new line closes each word and stands for the end mark inside the automaton's tokens.
        """
        found = [(end, token) for end, token in self.automaton.iter_long("\n".join(spelled) + "\n")]
        ends, tokens = np.array(found, np.int64).reshape(-1, 2).T
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
        owner = np.searchsorted(np.cumsum(sizes), ends, side="right")
        covered = np.bincount(owner, self.sizes[tokens], len(spelled)) == sizes
        return tokens, owner, covered

    def merged(self, word: str) -> list[int]:
        """The exact encoding: apply the lowest-ranked merge, the leftmost first, until none applies."""
        ids = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + END]]
        return self._merged_long(ids) if len(ids) > 64 else self._merged_short(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        get = self.merge.get
        best = [get(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while best and (low := min(best)) != NEVER:
            i = best.index(low)
            ids[i] = low & 0xFFFFF
            del ids[i + 1], best[i]
            if i:
                best[i - 1] = get(ids[i - 1] << 20 | ids[i], NEVER)
            if i < len(best):
                best[i] = get(ids[i] << 20 | ids[i + 1], NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words where looking through all pairs each time would be quadratic."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (m := self.merge.get(ids[i] << 20 | ids[after[i]])) is not None:
                heapq.heappush(heap, (m, i, ids[i], ids[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = m & 0xFFFFF, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [i for i in ids if i >= 0]

    def _learn(self, words: list[str]) -> None:
        """Encode words not met yet: guess all, check all adjacent pairs at once, merge those that fail."""
        spelled = [w.encode().decode("latin-1").translate(self.translation) for w in words]
        tokens, owner, covered = self._guess(spelled)
        bad = ~covered
        bad[owner[~self.sound[tokens]]] = True
        inside = owner[1:] == owner[:-1]
        keys, at = np.unique((tokens[:-1] << 20 | tokens[1:])[inside], return_inverse=True)
        clear = self.apart(keys >> 20, keys & 0xFFFFF)
        bad[owner[1:][inside][~clear[at]]] = True
        data = tokens.astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        for word, letters, start, stop, failed in zip(words, spelled, [0, *stops], stops, bad.tolist()):
            self.words[word] = array("I", self.merged(letters)).tobytes() if failed else data[start:stop]

    def pieces(self, text: str) -> list[str]:
        """The words of the text after normalisation. A special token stands for itself; no other word mixes marks and letters."""
        found: list[str] = []
        for part in self.cut.split(text) if self.cut else (text,):
            if part in self.special:
                found.append(part)
                continue
            if not part.isascii():
                # lower case by single letters, so the last sigma of a word is no exception
                part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")
            found += self.word.findall(part.lower())
        return found

    def forget(self) -> None:
        """Start the memory of words anew; special tokens are always known."""
        self.words = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(pieces), PORTION):
            portion = pieces[i : i + PORTION]
            fresh = set(portion).difference(self.words)
            if len(self.words) + len(fresh) > WORDS_KEPT:
                self.forget()
                fresh = set(portion).difference(self.words)
            if fresh:
                self._learn(list(fresh))
            out += map(self.words.__getitem__, portion)
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        waiting: list[str] = []
        ends: list[int] = []
        for text in texts:
            waiting += self.pieces(text)
            ends.append(len(waiting))
            if len(waiting) >= PORTION:
                yield from self._cut(self._lookup(waiting), ends)
                waiting, ends = [], []
        yield from self._cut(self._lookup(waiting), ends)

    @staticmethod
    def _cut(found: list[bytes], ends: list[int]) -> Iterator[bytes]:
        for start, end in zip([0, *ends], ends):
            yield b"".join(found[start:end])

    def decode(self, ids: bytes) -> bytes:
        """The text in UTF-8. The file has no decoder, so token names are joined by single spaces."""
        return b" ".join(map(self.utf8.__getitem__, memoryview(ids).cast("I").tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text as little-endian unsigned 32-bit integers in one binary.

    As the `tokenizers` library encodes with the file at `path` and add_special_tokens=False.

    Defined cases: null and empty texts have no ids; rows that repeat come out as often; a null doc_id
    stays null; other columns are ignored; no rows give no rows. A text of any length is looked up in
    portions of words, so the worker's memory follows the text and its ids only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            ids = bpe.encode(t or "" for t in values(batch.column("text")))
            yield from _out(batch.column("doc_id"), ids)
        # idle workers hold the vocabulary only
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def _out(doc_ids: pa.Array, ids: Iterator[bytes], decoded: Callable[[bytes], bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """The ids by document, and what they decode to if asked for, in batches of a few MB."""
    held: list[bytes] = []
    size = start = 0

    def batch() -> pa.RecordBatch:
        columns = [doc_ids.slice(start, len(held)), pa.array(held, pa.binary())]
        if decoded is None:
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids"])
        texts = pa.array([decoded(x) for x in held], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*columns, texts], ["doc_id", "ids", "decoded"])

    for x in ids:
        held.append(x)
        size += len(x)
        if size > 4 << 20:
            yield batch()
            start, held, size = start + len(held), [], 0
    yield batch()


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """`decode(encode(docs))` in one pass: (doc_id, ids, decoded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            ids = bpe.encode(t or "" for t in values(batch.column("text")))
            yield from _out(batch.column("doc_id"), ids, bpe.decode)
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The frame of `encode` with one more column: the text that the ids decode to, special tokens included.

    The file names no decoder, so the names of the tokens are joined by single spaces.
    A null stays null; no ids give the empty text.
    """
    columns = list(encoded.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = [None if x is None else bpe.decode(x).decode() for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*columns, "decoded"])

    return encoded.mapInArrow(lean(run), f"{encoded._jdf.schema().toDDL()}, decoded string")
