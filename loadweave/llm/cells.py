"""Buckets of look-alikes compared inside tasks: cells, their pairs, and the sizes of all intersections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole cells of a sorted partition, several at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        cells = batch.column("cell").to_numpy()
        # the last cell of the batch may go on in the next one
        cut = int(np.flatnonzero(cells != cells[-1]).max(initial=-1)) + 1
        if held and cut == 0 and held[-1].column("cell")[-1].as_py() == cells[0]:
            held.append(pa.Table.from_batches([batch]))
            continue
        if held and held[-1].column("cell")[-1].as_py() != cells[0]:
            yield pa.concat_tables(held)
            held = []
        if cut:
            yield pa.concat_tables([*held, pa.Table.from_batches([batch.slice(0, cut)])])
            held = []
        held.append(pa.Table.from_batches([batch.slice(cut)]))
    if held:
        yield pa.concat_tables(held)


def cells_of(table: pa.Table) -> list[tuple[int, int]]:
    cells = table.column("cell").to_numpy()
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(cells)]))


def all_pairs(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a cell; of a two-sided cell only those across."""
    i, j = np.triu_indices(len(side), 1)
    keep = (side[i] < 0) | (side[i] != side[j])
    return i[keep], j[keep]


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections, from a product of the incidence matrix in strips."""
    if len(sets) == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    every, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    # what only one set has is in no intersection
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[at]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    strip = 4096
    for lo in range(0, int(column.max(initial=-1)) + 1, strip):
        a, b = np.searchsorted(column, [lo, lo + strip])
        x = np.zeros((len(sets), strip), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        out += x @ x.T
    return out


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n members the smallest one that the links (i, j) connect with it."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
