"""Alignment of the tokens that two tokenizers make of a text.

Both token sequences cover the same bytes, so each is known by the byte offsets where its tokens end. The aligner runs down the
diagonal: as long as both arrays of ends agree at the current shift of their indices, tokens correspond one to
one, and such a stretch is passed in jumps that double while they hold and are halved where they fail. Where the
arrays part, the two are walked to their next common end, token by token; that group changes the shift.

How often two tokens are linked is a fact of the whole corpus. Pairs of ids are the columns of sparse rows
(`shards`), so what is shuffled is each shard's distinct pairs and not the links of its documents.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loadweave.llm.common import lean, stored
from loadweave.llm.shards import answered, key_rows, numbered, row_sums

#: Code points of text that are encoded in one call
PORTION = 1 << 18
#: Words remembered by one worker, and the longest that are; beyond that the memory starts anew
WORDS_KEPT = 200_000
LONGEST_KEPT = 400
#: Links after which a shard is closed
SHARD_LINKS = 1 << 20
#: Fixed value: how a byte-level tokenizer splits a text
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_WORD = re.compile(" +[^ ]*")
#: After a token inside a group, the last one of A, the last one of B
_MARKS = np.array([",", "|", ";"], object)
#: (first A, past the last A, first B, past the last B) of a group
Group = tuple[int, int, int, int]


def align(ends_a: list[int], ends_b: list[int]) -> tuple[list[Group], list[int]]:
    """The irregular groups of two token sequences over the same bytes, and the places of their overlapping pairs: A, B, A, B and so on.

    The arrays hold the offsets where tokens end, rising, with the same last one. The tokens between irregular groups correspond one to one.
    """
    groups: list[Group] = []
    links: list[int] = []
    i, j, n, m = 0, 0, len(ends_a), len(ends_b)
    while True:
        # jumps double while the ends agree at this shift ...
        jump = 1
        while (step := min(jump, n - i, m - j)) and ends_a[i : i + step] == ends_b[j : j + step]:
            i, j, jump = i + step, j + step, jump * 2
        # ... and are halved where they do not: less than `step` ends still agree
        jump = 1 << (step - 1).bit_length() >> 1 if step > 1 else 0
        while jump:
            if ends_a[i : i + jump] == ends_b[j : j + jump]:
                i, j = i + jump, j + jump
            jump //= 2
        if i == n:
            return groups, links
        from_a, from_b = i, j
        a, b = ends_a[i], ends_b[j]
        links += i, j
        while a != b:
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
            links += i, j
        i, j = i + 1, j + 1
        groups.append((from_a, i, from_b, j))


def groups_text(groups: list[Group], ids_a: list[str] | np.ndarray, ids_b: list[str] | np.ndarray) -> str:
    """All groups as `a1,a2|b1;a3|b2,b3`."""
    n, m = len(ids_a), len(ids_b)
    # a token's place among all is its own index and the number of the other side's tokens before it
    last_a, last_b = np.ones(n, bool), np.ones(m, bool)
    if groups:
        place = np.array(groups, np.int64)
        last_a, last_b = _outside(place[:, 0], place[:, 1] - 1, n), _outside(place[:, 2], place[:, 3] - 1, m)
    ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    at_a = np.arange(n) + np.repeat(np.r_[0, ends_b[:-1]], np.diff(ends_a, prepend=0))
    at_b = np.arange(m) + np.repeat(ends_a, np.diff(ends_b, prepend=0))
    out = np.empty(2 * (n + m), object)
    out[2 * at_a], out[2 * at_b] = ids_a, ids_b
    out[2 * at_a + 1], out[2 * at_b + 1] = _MARKS[np.where(last_a, 1, 0)], _MARKS[np.where(last_b, 2, 0)]
    return "".join(out[:-1].tolist())


def linked_pairs(groups: list[Group], links: list[int], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pair of ids of every link, the A id in the upper 32 bits."""
    if not groups:
        return a << 32 | b
    place = np.array(groups, np.int64)
    one_a, one_b = _outside(place[:, 0], place[:, 1], len(a)), _outside(place[:, 2], place[:, 3], len(b))
    at = np.array(links, np.int64).reshape(-1, 2)
    return np.concatenate([a[one_a] << 32 | b[one_b], a[at[:, 0]] << 32 | b[at[:, 1]]])


def _outside(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """The places that lie in none of the ranges, which are apart and rising."""
    step = np.zeros(n + 1, np.int64)
    # starts, and stops, are distinct
    step[starts] += 1
    step[stops] -= 1
    return np.cumsum(step[:n]) == 0


class Tokenizers:
    """The two tokenizers, with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: bytes([b]) for b, c in _byte_letters().items()}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = np.full(max(vocab.values()) + 1, b"", object)
        for t, i in vocab.items():
            self.bytes_a[i] = b"".join(byte.get(c, c.encode()) for c in t)
        self.bytes_b = np.array(
            [
                bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode()
                for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
            ],
            object,
        )
        self.lengths_a, self.lengths_b = (np.array([*map(len, x)], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.numerals = np.array([*map(str, range(max(len(self.lengths_a), len(self.lengths_b))))], object)
        self.ranked = self._ranked(path_a)
        self.apart = _words_apart(self.b)
        self.known_b: dict[str, bytes] = {}

    def _ranked(self, path: str):
        """A faster encoder with the same result where the file's merges are in the order of the ids; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        split = own["pre_tokenizer"] or {}
        vocab = own["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in own["model"]["merges"]]
        first = len(vocab) - len(pairs)
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and own["normalizer"] is None
        if not plain or first != 256 or any(vocab.get(x + y) != first + n for n, (x, y) in enumerate(pairs)):
            return None
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks={self.bytes_a[i]: i for i in vocab.values()}, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            try:
                return [self.ranked.encode_ordinary(t) for t in texts]
            except Exception:  # its regular expressions give up on some texts; the library does not
                pass
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that are not empty. Where no piece goes on past the end of a word, words are encoded by themselves and remembered."""
        if not self.apart:
            return [np.array(x, np.int32) for x in self.b.encode(texts, num_threads=1)]
        words = [_words(t) for t in texts]
        wanted = set().union(*words)
        if len(self.known_b) + len(wanted) > WORDS_KEPT:
            self.known_b = {}
        fresh = list(wanted.difference(self.known_b))
        ids = self.b.encode(fresh, num_threads=1)
        stops = (4 * np.cumsum([0, *map(len, ids)])).tolist()
        flat = np.fromiter(chain.from_iterable(ids), np.int32).tobytes()
        self.known_b.update(zip(fresh, map(flat.__getitem__, map(slice, stops, stops[1:]))))
        known = self.known_b.__getitem__
        return [np.frombuffer(b"".join(map(known, w)), np.int32) if w else np.array(self.b.encode(t, num_threads=1), np.int32) for t, w in zip(texts, words)]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of both, none where a text is empty or the tokens do not give it back."""
        some = [t for t in texts if t]
        both = zip(self.encode_a([" " + t for t in some]), self.encode_b(some))
        none = np.zeros(0, np.int64)
        for text in texts:
            if not text:
                yield none, none
                continue
            a, b = (np.array(x, np.int64) for x in next(both))
            raw = b" " + text.encode()
            whole = b"".join(self.bytes_a[a].tolist()) == raw and b"".join(self.bytes_b[b].tolist()) == raw
            yield (a, b) if whole else (none, none)


def _words_apart(b) -> bool:
    """Whether the model's tokens of a text are those of its words, each with the spaces before it, one after the other.

    So it is where merges alone cut the text as it stands and no piece has a space after anything else.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(b.serialized_model_proto())
    how, form = model.trainer_spec, model.normalizer_spec
    plain = how.model_type == how.BPE and how.byte_fallback and not how.treat_whitespace_as_suffix
    same = form.add_dummy_prefix and form.escape_whitespaces and not form.remove_extra_whitespaces and not form.precompiled_charsmap
    kinds = {p.type for p in model.pieces} <= {1, 2, 3, 6}  # plain, unknown, control and byte pieces
    return plain and same and kinds and not any("\u2581" in p.piece.lstrip("\u2581") for p in model.pieces)


def _words(text: str) -> list[str]:
    """The words with the spaces before them but one; none where the text is to be encoded whole."""
    if "\u2581" in text:
        return []
    words = text.split(" ")
    if "" in words:
        words = [w[1:] for w in _WORD.findall(" " + text)]
    # an empty word is a space at the end, which is nothing by itself
    return [] if not words[-1] or len(max(words, key=len)) > LONGEST_KEPT else words


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def _portions(texts: list[str | None]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= PORTION:
            yield held
            held, size = [], 0
    if held:
        yield held


def _shard(number: int, doc_ids: list[pa.Array], rows: list[dict], links: list[np.ndarray]) -> pa.RecordBatch:
    local, keys = pd.factorize(np.concatenate(links))
    row = np.repeat(np.arange(len(links)), [len(x) for x in links])
    # in the order of their first places, so row by row
    code, entries = pd.factorize(row * max(1, len(keys)) + local)
    counts = np.bincount(code, minlength=len(entries))
    row, local = np.divmod(entries, max(1, len(keys)))
    indptr = np.searchsorted(row, np.arange(len(links) + 1)).astype(np.int64)
    ids = pa.concat_arrays(doc_ids)
    columns = {n: pa.array([[r[n] for r in rows]], t) for n, t in _ROW.items()}
    return pa.RecordBatch.from_pydict(
        {"shard": pa.array([number], pa.int64()), "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)}
        | columns
        | {
            "indptr": pa.array([indptr.tobytes()], pa.binary()),
            "indices": pa.array([local.astype(np.int32).tobytes()], pa.binary()),
            "counts": pa.array([counts.astype(np.int32).tobytes()], pa.binary()),
            "keys": pa.array([keys], pa.list_(pa.int64())),
            "totals": pa.array([np.bincount(local, counts, len(keys)).astype(np.int64)], pa.list_(pa.int64())),
        }
    )


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_ROW = {n: pa.list_(pa.int64()) for n in _COUNTS} | {"groups_sha256": pa.list_(pa.string())}

def _align_text(both: Tokenizers, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[dict, np.ndarray]:
    """A document's counts and digest, and the pair of ids of each of its links."""
    if not len(ids_a):
        return dict.fromkeys(_COUNTS, 0) | {"groups_sha256": ""}, np.zeros(0, np.int64)
    groups, links = align(np.cumsum(both.lengths_a[ids_a]).tolist(), np.cumsum(both.lengths_b[ids_b]).tolist())
    text = groups_text(groups, both.numerals[ids_a], both.numerals[ids_b])
    pairs = linked_pairs(groups, links, ids_a, ids_b)
    n_groups = len(ids_a) - sum(p - i - 1 for i, p, _, _ in groups)
    row = {"n_a": len(ids_a), "n_b": len(ids_b), "n_groups": n_groups, "n_links": len(pairs), "groups_sha256": sha256(text.encode()).hexdigest()}
    return row, pairs


def alignment_shards(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The aligned documents in shards: lists of doc_ids and of each document's counts, and CSR rows of linked pairs of ids.

    `keys` are the shard's distinct pairs, the A id in the upper 32 bits, and `totals` how often each occurs in the shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        numbers = numbered(TaskContext.get().partitionId())
        ids: list[pa.Array] = []
        rows: list[dict] = []
        links: list[np.ndarray] = []
        size = 0
        for batch in batches:
            done = 0
            for texts in _portions(batch.column("text").to_pylist()):
                for a, b in both.encode(texts):
                    row, pairs = _align_text(both, a, b)
                    rows.append(row)
                    links.append(pairs)
                    size += len(pairs) + 32
                ids.append(batch.column("doc_id").slice(done, len(texts)))
                done += len(texts)
                if size >= SHARD_LINKS:
                    yield _shard(next(numbers), ids, rows, links)
                    ids, rows, links, size = [], [], [], 0
        if rows:
            yield _shard(next(numbers), ids, rows, links)

    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = f"doc_ids array<{kind}>, " + ", ".join(f"{n} array<{'string' if n == 'groups_sha256' else 'bigint'}>" for n in _ROW)
    schema = f"shard long, {lists}, indptr binary, indices binary, counts binary, keys array<bigint>, totals array<bigint>"
    return stored(docs.select("doc_id", "text").mapInArrow(lean(run), schema))


def pair_counts(shards: DataFrame) -> DataFrame:
    """(key, total, best): how many links of the corpus hold each pair of ids, and whether that is the most for its B id."""
    pairs = shards.select(F.explode(F.arrays_zip("keys", "totals")).alias("p")).select(F.col("p.keys").alias("key"), F.col("p.totals").alias("n"))
    totals = stored(pairs.groupBy("key").agg(F.sum("n").alias("total")).withColumn("b", F.col("key").bitwiseAND((1 << 32) - 1)))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("key", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every document.

    Space and text are encoded by the tokenizers file at `path_a` (A), the text by the sentencepiece model at `path_b` (B), which adds the
    space itself; the strings of special tokens are plain text. Offsets where tokens of both end cut them into groups; tokens whose
    bytes overlap are linked. `n_best` counts the links whose pair of ids has the highest count of the corpus for its B id, ties included;
    `count_sum` sums the counts of the links' pairs.

    Defined cases: null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens: zeros and an
    empty `groups_sha256`; rows that repeat are documents of their own and count as often; a null doc_id stays null; other columns
    are ignored; no rows give no rows. A text of any length is aligned whole, in memory of a multiple of its own size.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shards = alignment_shards(docs, path_a, path_b)
    answers = key_rows(shards).join(stored(pair_counts(shards)), "key")

    def judge(row: dict, found: dict[str, np.ndarray]) -> dict:
        indptr, local, counts = (np.frombuffer(row[c], t) for c, t in (("indptr", np.int64), ("indices", np.int32), ("counts", np.int32)))
        return row | {"n_best": row_sums(indptr, found["best"][local] * counts), "count_sum": row_sums(indptr, found["total"][local] * counts)}

    names = ["doc_ids", *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    schema = ", ".join(f"{n} array<{kind if n == 'doc_ids' else 'string' if n == 'groups_sha256' else 'bigint'}>" for n in names)
    out = answered(shards.drop("totals"), answers, ["total", "best"], judge, schema)
    return out.select(F.inline(F.arrays_zip(*names))).select(F.col("doc_ids").alias("doc_id"), *names[1:])
