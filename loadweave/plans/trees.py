"""Gradient-boosted regression trees, grown in one barrier job.

Every task bins its share of the rows once and keeps them. A step of growth needs the sums of residuals by leaf, feature and
bin. The tasks run at the same time and exchange these through files in the shared folder, so a thousand rounds cost one
job (`allGather` of the barrier context looks for its answer once a second, too seldom for thousands of steps). Only the
smaller child of a split is summed, its sibling is the difference to the parent. Trees grow level by level to a depth,
or leaf by leaf, the largest gain first, to a number of leaves. Models of several seeds grow side by side and share
the exchanges.

Residuals are whole multiples of a unit, a power of two, so all sums are exact, and rows are drawn by a hash of their
values: the model does not depend on the number of tasks or on where the rows lie. A lost executor makes Spark run
the barrier stage again from the stored rows.
"""

from __future__ import annotations

import heapq
import math
import time
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext

TREES = "seed long, round int, node int, depth int, feature int, threshold double, left int, right int, value double, gain double, n long"
#: Residuals have so many bits, so that a float adds up 2**23 of them exactly
BITS = 30
#: Rows that are summed at a time
CHUNK = 1 << 18
#: Seconds that a task waits for the sums of another one
LONGEST_WAIT = 900
#: A smaller share of the sums of squares is no gain
LEAST_GAIN = 1e-10

_GOLDEN = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def drawn(rows: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """The rows (hashes) that take part in a round."""
    if share >= 1:
        return np.arange(len(rows))
    salt = np.uint64((seed * 0xD6E8FEB86659FD93 + turn * _GOLDEN) % (1 << 64))
    return np.flatnonzero(_mixed(_mixed(rows ^ salt)) < np.uint64(int(share * 2.0**64) - 1))


def edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Where a feature may be split: between its values, or at quantiles if there are more values than bins."""
    distinct = np.unique(values)
    if len(distinct) <= bins:
        return (distinct[1:] + distinct[:-1]) / 2
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="inverted_cdf"))


@dataclass
class Split:
    """The best split of a leaf: rows up to the edge `cut` of `feature` go left."""

    gain: float
    feature: int
    cut: int
    left: tuple[int, int]
    right: tuple[int, int]


def best_split(sums: np.ndarray, counts: np.ndarray, min_leaf: int) -> Split | None:
    """The split of a leaf (features x bins) that lowers the squared error most; the first of equal ones."""
    left, n_left = np.cumsum(sums, 1)[:, :-1], np.cumsum(counts, 1)[:, :-1]
    total, n = int(sums[0].sum()), int(counts[0].sum())
    right, n_right = total - left, n - n_left
    allowed = (n_left >= min_leaf) & (n_right >= min_leaf)
    if not allowed.any():
        return None
    squares = np.where(allowed, left.astype(float) ** 2 / np.maximum(n_left, 1) + right.astype(float) ** 2 / np.maximum(n_right, 1), -np.inf)
    at = int(squares.argmax())
    f, b = divmod(at, squares.shape[1])
    gain = float(squares[f, b]) - float(total) ** 2 / n
    if gain <= LEAST_GAIN * float(squares[f, b]):
        return None
    return Split(gain, f, b, (int(left[f, b]), int(n_left[f, b])), (int(right[f, b]), int(n_right[f, b])))


@dataclass
class Tree:
    """A tree that grows: nodes as (depth, feature, cut, left, right, sum, n, gain), a feature of -1 for leaves."""

    depth: int | None
    leaves: int | None
    min_leaf: int
    nodes: list[list] = field(default_factory=list)
    open: list[tuple] = field(default_factory=list)
    known: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    n_leaves: int = 1

    def learn(self, leaf: int, sums: np.ndarray, counts: np.ndarray) -> None:
        """Take in the sums of a leaf."""
        if not self.nodes:
            self.nodes.append([0, -1, 0, 0, 0, int(sums[0].sum()), int(counts[0].sum()), 0.0])
        split = best_split(sums, counts, self.min_leaf)
        if split:
            self.known[leaf] = sums, counts
            heapq.heappush(self.open, (-split.gain, leaf, split))

    def advance(self, at: np.ndarray, binned: np.ndarray) -> list[tuple[int, int, int]]:
        """Split what is next, and move the rows; (leaf to sum, its parent, its sibling) of each split that can go on."""
        ready = self.open if self.leaves is None else None
        if ready is not None:
            self.open = []
        asked: list[tuple[int, int, int]] = []
        while ready or (ready is None and self.open and self.n_leaves < self.leaves and not asked):
            _, leaf, split = heapq.heappop(self.open) if ready is None else ready.pop(0)
            node = self.nodes[leaf]
            a, b = len(self.nodes), len(self.nodes) + 1
            for s, n in (split.left, split.right):
                self.nodes.append([node[0] + 1, -1, 0, 0, 0, s, n, 0.0])
            node[1:5], node[7] = [split.feature, split.cut, a, b], split.gain
            self.n_leaves += 1
            here = np.flatnonzero(at == leaf)
            at[here] = np.where(binned[here, split.feature] <= split.cut, a, b)
            last = self.n_leaves == self.leaves if self.leaves is not None else node[0] + 1 >= self.depth
            if last or max(split.left[1], split.right[1]) < 2 * self.min_leaf:
                del self.known[leaf]
                continue
            asked.append((a, leaf, b) if split.left[1] <= split.right[1] else (b, leaf, a))
        return asked


def _sums(asked: list[int], n_nodes: int, at: np.ndarray, bag: np.ndarray, binned: np.ndarray, residual: np.ndarray, width: int) -> list[np.ndarray]:
    """This task's sums and counts by asked leaf, feature and bin."""
    n_features = binned.shape[1]
    slot = np.full(n_nodes, -1)
    slot[asked] = np.arange(len(asked))
    place = slot[at[bag]]
    rows, place = bag[place >= 0], place[place >= 0]
    size = len(asked) * n_features * width
    sums, counts = np.zeros(size, np.int64), np.zeros(size, np.int64)
    step = np.arange(n_features) * width
    for i in range(0, len(rows), CHUNK):
        some = rows[i : i + CHUNK]
        flat = (place[i : i + CHUNK, None] * (n_features * width) + step + binned[some]).ravel()
        counts += np.bincount(flat, minlength=size)
        sums += np.bincount(flat, np.repeat(residual[some], n_features), size).astype(np.int64)
    return [sums, counts]


class Exchange:
    """Sums over the tasks of a barrier stage, step by step, through a folder that all of them reach.

    Each task writes one file a step and reads those of the others. Who has read all files of a step knows that the step before is
    over everywhere, and removes its file of that step. Every attempt of the stage has a folder of its own.
    """

    def __init__(self, folder: str):
        context = BarrierTaskContext.get()
        self.task, self.step = context.partitionId(), 0
        attempt = context.allGather(uuid.uuid4().hex)
        self.others = [k for k in range(len(attempt)) if k != self.task]
        self.files, path = fs.FileSystem.from_uri(folder)
        self.path = f"{path}/{attempt[0]}"
        self.files.create_dir(self.path)

    def total(self, own: np.ndarray) -> np.ndarray:
        """The sum of all tasks' arrays of whole numbers."""
        if not self.others:
            return own
        mine = f"{self.path}/{self.step}-{self.task}"
        with self.files.open_output_stream(mine + ".part") as out:
            out.write(zlib.compress(own.tobytes(), 1))
        self.files.move(mine + ".part", mine)
        total = own.copy()
        for k in self.others:
            total += np.frombuffer(zlib.decompress(self._read(f"{self.path}/{self.step}-{k}")), np.int64)
        if self.step:
            self.files.delete_file(f"{self.path}/{self.step - 1}-{self.task}")
        self.step += 1
        return total

    def _read(self, name: str) -> bytes:
        wait, waited = 0.0002, 0.0
        while True:
            try:
                with self.files.open_input_stream(name) as file:
                    return file.read()
            except FileNotFoundError:
                if waited > LONGEST_WAIT:
                    raise TimeoutError(f"no sums of another task in {waited:.0f} s") from None
                time.sleep(wait)
                waited += wait
                wait = min(wait * 1.5, 0.02)


def grow(cuts: Sequence[np.ndarray], rounds: int, depth: int | None, leaves: int | None, rate: float, share: float, min_leaf: int, seeds: Sequence[int], folder: str):
    """The task of the barrier job: rows (__hash, __target, features...) in, the nodes of all trees out, from the first task."""
    width = max(len(c) for c in cuts) + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, target, binned = _loaded(batches, cuts)
        exchange = Exchange(folder)
        # as powers of two, of which each task marks its own
        powers = np.zeros(4096, np.int64)
        powers[math.ceil(math.log2(float(np.abs(target).max(initial=0.0)) or 1.0)) + 2048] = 1
        unit = 2.0 ** (int(np.flatnonzero(exchange.total(powers)).max()) - 2048 + 1 - BITS)
        total, n = exchange.total(np.array([np.rint(target / unit).astype(np.int64).sum(), len(rows)], np.int64))
        base = float(total) / n * unit
        fitted = [np.full(len(rows), base) for _ in seeds]
        out = [(s, -1, 0, 0, -1, 0.0, 0, 0, base, 0.0, int(n)) for s in seeds]
        for turn in range(rounds):
            residuals = [np.rint((target - f) / unit).astype(np.int64) for f in fitted]
            bags = [drawn(rows, s, turn, share) for s in seeds]
            trees = [Tree(depth, leaves, min_leaf) for _ in seeds]
            at = [np.zeros(len(rows), np.int32) for _ in seeds]
            asked: list[list[tuple[int, int, int]]] = [[(0, -1, -1)] for _ in seeds]
            while any(asked):
                parts = [_sums([a[0] for a in w], max(1, len(trees[k].nodes)), at[k], bags[k], binned, residuals[k], width) for k, w in enumerate(asked) if w]
                every = exchange.total(np.concatenate([x for pair in parts for x in pair]))
                done = 0
                for tree, wanted in zip(trees, asked):
                    shape = (len(wanted), len(cuts), width)
                    size = math.prod(shape)
                    sums, counts = every[done : done + size].reshape(shape), every[done + size : done + 2 * size].reshape(shape)
                    done += 2 * size
                    for k, (leaf, parent, sibling) in enumerate(wanted):
                        tree.learn(leaf, sums[k], counts[k])
                        if parent >= 0:
                            above = tree.known.pop(parent)
                            tree.learn(sibling, above[0] - sums[k], above[1] - counts[k])
                asked = [tree.advance(at[k], binned) for k, tree in enumerate(trees)]
            for k, (seed, tree) in enumerate(zip(seeds, trees)):
                value = np.array([s / max(1, c) * unit * rate for *_, s, c, _ in tree.nodes])
                fitted[k] += value[at[k]]
                out += [
                    (seed, turn, i, d, f, float(cuts[f][cut]) if f >= 0 else 0.0, a, b, float(value[i]) if f < 0 else 0.0, g * unit * unit, c)
                    for i, (d, f, cut, a, b, _, c, g) in enumerate(tree.nodes)
                ]
            if exchange.task == 0 and (len(out) > 10_000 or turn == rounds - 1):
                yield _nodes(out)
            if len(out) > 10_000:
                out = []
        if rounds == 0 and exchange.task == 0:
            yield _nodes(out)

    return task


_ARROW = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
NODE = [f.split()[0] for f in TREES.split(", ")]


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], NODE)


def _loaded(batches: Iterator[pa.RecordBatch], cuts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, targets and bins of the task's rows."""
    kind = np.uint8 if max(map(len, cuts)) < 256 else np.uint16
    parts = [(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, len(cuts)), kind))]
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        binned = np.stack([np.searchsorted(e, v).astype(kind) for e, v in zip(cuts, columns[2:], strict=True)], 1)
        parts.append((columns[0].view(np.uint64), columns[1], binned))
    return tuple(np.concatenate(p) for p in zip(*parts))


class Forest:
    """Trees as arrays: (seed, tree, node), for prediction. Leaves lead to themselves."""

    def __init__(self, nodes: list):
        first = [n for n in nodes if n["round"] < 0]
        self.seeds = sorted({n["seed"] for n in first})
        self.base = np.array([next(n["value"] for n in first if n["seed"] == s) for s in self.seeds])
        grown = [n for n in nodes if n["round"] >= 0]
        rounds, size = max((n["round"] for n in grown), default=-1) + 1, max((n["node"] for n in grown), default=0) + 1
        shape = (len(self.seeds), rounds, size)
        self.feature, self.left, self.right = (np.zeros(shape, np.int32) for _ in range(3))
        self.threshold, self.value = np.full(shape, np.inf), np.zeros(shape)
        self.depth = max((n["depth"] for n in grown), default=0)
        which = {s: i for i, s in enumerate(self.seeds)}
        for n in grown:
            at = which[n["seed"]], n["round"], n["node"]
            if n["feature"] < 0:
                self.left[at] = self.right[at] = n["node"]
                self.value[at] = n["value"]
            else:
                self.feature[at], self.threshold[at], self.left[at], self.right[at] = n["feature"], n["threshold"], n["left"], n["right"]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(seeds x rows) predictions."""
        out = np.repeat(self.base[:, None], len(x), 1)
        n_trees = self.feature.shape[1]
        step = max(1, (1 << 18) // max(1, n_trees))
        tree = np.arange(n_trees)
        for s in range(len(self.seeds)):
            for i in range(0, len(x) if n_trees else 0, step):
                some = x[i : i + step]
                row = np.arange(len(some))[:, None]
                node = np.zeros((len(some), n_trees), np.int32)
                for _ in range(self.depth):
                    low = some[row, self.feature[s][tree, node]] <= self.threshold[s][tree, node]
                    node = np.where(low, self.left[s][tree, node], self.right[s][tree, node])
                out[s, i : i + step] += self.value[s][tree, node].sum(1)
        return out
