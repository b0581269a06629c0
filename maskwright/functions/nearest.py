"""The highest cosine of vectors to the unit vectors of their group, in numpy, over rows sorted by group.

Executors get these functions by value.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 2_000_000  # products held at once


def _matrices(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length; null vectors and those that hold a null are in none."""
    lengths = np.array(pc.fill_null(pc.list_value_length(vectors), -1))
    values = vectors.flatten()
    if values.null_count:
        lengths[np.array(pc.list_parent_indices(vectors))[np.array(pc.is_null(values))]] = -1
    for length in np.unique(lengths[lengths >= 0]):
        places = np.flatnonzero(lengths == length)
        taken = values if len(places) == len(vectors) else vectors.take(pa.array(places)).flatten()
        yield places, np.array(taken, dtype="float64").reshape(len(places), length)


def best_cosines(rows: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The highest product of each row, at length one, with ``units``; NaN if one product is.

    A matrix product finds those that can be the highest within its rounding, and these are summed
    again in order, so the result does not depend on how rows are grouped.
    """
    with np.errstate(all="ignore"):
        columns, others = np.ascontiguousarray(rows.T), np.ascontiguousarray(units.T)
        square = np.zeros(len(rows))
        for x in columns:
            square += x * x
        size = np.sqrt(square)
        columns /= np.where((size > 0) | np.isnan(size), size, 1.0)
        rows = np.ascontiguousarray(columns.T)
        reach = np.sqrt((rows * rows).sum(1)) * np.sqrt((units * units).sum(1)).max()
        slack = 4 * (rows.shape[1] + 2) * np.finfo("float64").eps * reach
        best, step = np.empty(len(rows)), max(1, CELLS // len(units))
        for at in range(0, len(rows), step):
            near = rows[at : at + step] @ units.T
            top = near.max(1)
            i, j = np.nonzero(near >= (top - slack[at : at + step])[:, None])
            exact = np.zeros(len(i))
            for x, y in zip(columns, others):
                exact += x[at + i] * y[j]
            if len(i):
                first = np.flatnonzero(np.diff(i, prepend=-1))
                top[i[first]] = np.maximum.reduceat(exact, first)
            best[at : at + step] = top
    return best


def nearest_of_groups(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """For batches of (keys of the group, whether it is a prototype, vector): each other row's best cosine.

    Rows come sorted by group, prototypes (of length one) first. One group's prototypes are held; null where
    a group has none of the vector's length.
    """
    last, units = None, {}
    for *keys, proto, vectors in batches:
        n = len(vectors)
        best, found = np.zeros(n), np.zeros(n, bool)
        changed = np.zeros(max(n - 1, 0), bool)
        for key in keys:
            one, two = key[:-1], key[1:]
            other_null = np.array(pc.not_equal(one.is_null(), two.is_null()), dtype=bool)
            changed |= np.array(pc.fill_null(pc.not_equal(one, two), False), dtype=bool) | other_null
        is_proto = np.array(proto, dtype=bool)
        starts = [0, *(np.flatnonzero(changed) + 1), n] if n else []
        for start, end in zip(starts, starts[1:]):
            group = [key[int(start)].as_py() for key in keys]
            if group != last:
                last, units = group, {}
            own = int(start + is_proto[start:end].sum())
            for _, matrix in _matrices(vectors[int(start) : own]):
                units.setdefault(matrix.shape[1], []).append(matrix)
            if not units or own == end:
                continue
            for places, matrix in _matrices(vectors[own : int(end)]):
                held = units.get(matrix.shape[1])
                if held:
                    held[:] = [np.concatenate(held)] if len(held) > 1 else held
                    best[own + places], found[own + places] = best_cosines(matrix, held[0]), True
        yield pa.array(best, mask=~found)
