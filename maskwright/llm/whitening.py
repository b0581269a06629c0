"""Whitening of vectors on their leading principal components, by Jacobi-Davidson.

The covariance matrix is never formed. A product of it with a few vectors is one pass over the
distinct vectors, each centred before it is multiplied. The driver holds as many vectors of the
table's dimension as a search basis has; rows stay where they are.

A step takes the Ritz pairs of the basis, locks those whose residual has reached the rounding of a
product, and widens the basis by corrections: for every pair that is still open the projected
equation (I - QQ')(V - e I)(I - QQ') t = -r, solved by a few steps of MINRES. All open pairs share
the passes of those steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.tables import saved

#: Bytes of a block of distinct vectors: what a pass holds at once.
BLOCK_BYTES = 2_000_000
#: Partial sums of so many tasks are added up in a task before the driver gets them.
FAN_IN = 64
#: Entries whose 64-fold reaches this are treated like those that are not finite.
MOST = 2.0**60
EPS = float(np.finfo(np.float64).eps)


def integers(vector: Column) -> Column:
    """floor(64 c) + 1,000,000 of each entry; null if an entry is null, not finite or too large."""
    scaled = F.transform(vector, lambda c: c.cast("double") * F.lit(64.0))
    fine = F.forall(scaled, lambda c: F.coalesce(F.abs(c) < F.lit(MOST), F.lit(False)) & ~F.isnan(c))
    return F.when(fine, F.transform(scaled, lambda c: F.floor(c).cast("bigint") + F.lit(1_000_000).cast("bigint")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, d)


@dataclass
class FitList:
    """The distinct vectors in blocks, and what is known of them exactly."""

    blocks: DataFrame
    d: int
    n: int
    sums: list[int]
    parts: int

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        """x - S/n in doubles: the whole part of S/n is taken off in integers."""
        whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return lambda x: (x - whole).astype(np.float64) - rest

    def deviations(self) -> Callable[[np.ndarray], list[int]]:
        """Sums over dimensions of (n x - S)^2, exact."""
        n, d = self.n, self.d
        whole = np.array([s // n for s in self.sums], dtype=np.int64)
        rest = np.array([s % n for s in self.sums], dtype=np.int64)

        def of(x: np.ndarray) -> list[int]:
            off = x - whole
            if d * (n * (float(np.abs(off).max(initial=0)) + 1)) ** 2 < 2.0**62:
                return ((off * n - rest) ** 2).sum(axis=1).tolist()
            return [int(v) for v in ((off.astype(object) * n - rest.astype(object)) ** 2).sum(axis=1)]

        return of

    def total(self, of_block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all blocks of a matrix of centred rows. Tasks add up their own blocks; their
        sums are added in the order of the tasks, so that reruns round alike."""
        centre, d = self.centre(), self.d

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(shape)
            for batch in batches:
                for block in batch.column(0):
                    found += of_block(centre(np.frombuffer(block.as_py(), np.int64).reshape(-1, d)))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([found.tobytes()])], ["part", "sums"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, part = np.zeros(shape), -1
            for batch in batches:
                for p, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found, part = found + np.frombuffer(sums.as_py()).reshape(shape), p
            if part >= 0:
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([found.tobytes()])], ["part", "sums"])

        schema = "part bigint, sums binary"
        sums = self.blocks.select("block").mapInArrow(partial, schema)
        if self.parts > FAN_IN:
            dealt = sums.repartitionByRange(-(-self.parts // FAN_IN), "part").sortWithinPartitions("part")
            sums = dealt.mapInArrow(merged, schema)
        found = np.zeros(shape)
        for r in sorted(sums.collect(), key=lambda r: r["part"]):
            found += np.frombuffer(r["sums"]).reshape(shape)
        return found

    def covariance_times(self, vectors: np.ndarray) -> np.ndarray:
        """V times the columns of ``vectors``: one pass, divisor n."""
        return self.total(lambda y: y.T @ (y @ vectors), vectors.shape) / self.n


def fit_list(whole: DataFrame, d: int) -> FitList | None:
    """The distinct vectors of ``whole`` (x: arrays of ``d`` integers), or none if there are none."""
    most = max(1, BLOCK_BYTES // (8 * d))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            x = np.concatenate(held)
            sums = [Decimal(int(s)) for s in (x.sum(axis=0) if np.abs(x).max() < 2**62 // len(x) else x.astype(object).sum(axis=0))]
            own = [pa.array([len(x)]), pa.array([sums], pa.list_(pa.decimal128(38, 0))), pa.array([x.tobytes()])]
            return pa.RecordBatch.from_arrays(own, ["rows", "sums", "block"])

        for batch in batches:
            x = _matrix(batch.column(0), d)
            while len(x):
                room = most - sum(map(len, held))
                held.append(x[:room])
                x = x[room:]
                if sum(map(len, held)) == most:
                    yield row()
                    held.clear()
        if held:
            yield row()

    schema = "rows bigint, sums array<decimal(38,0)>, block binary"
    blocks = saved(whole.select("x").distinct().mapInArrow(pack, schema), "distinct")
    n = blocks.agg(F.sum("rows")).first()[0] or 0
    if not n:
        return None
    sums = blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    in_order = [int(r["s"]) for r in sorted(sums, key=lambda r: r["pos"])]
    return FitList(blocks, d, n, in_order, blocks.rdd.getNumPartitions())


def _orthonormal(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Columns that span ``new`` beyond ``old``; those that add nothing are left out."""
    scale = np.linalg.norm(new, axis=0)
    new = new[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        new = new - old @ (old.T @ new)
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    u = u[:, s > 1e-10]
    for _ in range(2):
        u = u - old @ (old.T @ u)
        u = np.linalg.qr(u)[0]
    return u


def _minres(times: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """MINRES for several right-hand sides at once; ``times`` applies each column's own symmetric
    operator. A column rests once its residual is ``enough`` of what it was."""
    tiny = float(np.finfo(np.float64).tiny)
    zero = np.zeros(b.shape[1])
    x, w, w_old = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    v_old, v = np.zeros_like(b), b / np.maximum(beta, tiny)
    left, goal = beta.copy(), enough * beta
    beta_old, cos, sin, bar, far = zero, zero - 1, zero, zero, zero
    for _ in range(steps):
        open_now = left > goal
        if not open_now.any():
            break
        y = times(v) - beta_old * v_old  # Lanczos: the next column of the tridiagonal matrix
        alpha = (v * y).sum(axis=0)
        y = y - alpha * v
        beta_old = np.linalg.norm(y, axis=0)
        above, diagonal = cos * bar + sin * alpha, sin * bar - cos * alpha  # under the rotation before
        far, far_old, bar = sin * beta_old, far, -cos * beta_old
        gamma = np.maximum(np.hypot(diagonal, beta_old), tiny)
        cos, sin = diagonal / gamma, beta_old / gamma
        w, w_old = (v - far_old * w_old - above * w) / gamma, w
        x = x + np.where(open_now, cos * left, 0.0) * w
        left = np.where(open_now, sin * left, left)
        v, v_old = y / np.maximum(beta_old, tiny), v
    return x


def leading_pairs(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, inner: int = 6, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors (d by k) of a symmetric matrix
    without negative eigenvalues, known by its products with blocks of vectors.

    A pair is locked when all before it are and its residual is no more than the rounding of a product:
    8 sqrt(d) units in the last place of the largest eigenvalue. Where the rounding of the products
    is coarser than that, it ends when three steps in a row no longer lower the residuals.
    """
    draw = np.random.default_rng(seed)
    most = min(d, max(4 * k, 32))
    basis = np.linalg.qr(draw.standard_normal((d, min(d, k + 8))))[0]
    images = times(basis)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    best, idle = np.inf, 0
    while True:
        open_k = k - len(values)
        inside = basis.T @ images
        theta, turn = np.linalg.eigh((inside + inside.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, images = basis @ turn, images @ turn
        top = max(float(theta[0]), float(values.max(initial=0)))
        off = images[:, :open_k] - basis[:, :open_k] * theta[:open_k]
        off = off - locked @ (locked.T @ off)
        size = np.linalg.norm(off, axis=0)
        idle = idle + 1 if size.max() > best / 2 else 0
        best = min(best, size.max())
        fine = size <= 8 * np.sqrt(d) * EPS * top
        if idle >= 3 and best <= 1e-10 * top:
            fine[:] = True
        n = open_k if fine.all() else int(np.argmin(fine))
        locked, values = np.hstack([locked, basis[:, :n]]), np.concatenate([values, theta[:n]])
        if len(values) == k:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        basis, images, theta, off = basis[:, n:], images[:, n:], theta[n:], off[:, n:]
        if n:
            best, idle = np.inf, 0
        wanted = k - len(values)
        near = np.hstack([locked, basis[:, :wanted]])

        def projected(w: np.ndarray) -> np.ndarray:
            w = w - near @ (near.T @ w)
            y = times(w) - w * theta[:wanted]
            return y - near @ (near.T @ y)

        fresh = np.zeros((d, 0))
        if basis.shape[1] + len(values) < d:
            if basis.shape[1] + wanted > most:  # begin again from the leading Ritz vectors
                basis, images = basis[:, : wanted + 8], images[:, : wanted + 8]
            start = -(off - near @ (near.T @ off))
            corrections = _minres(projected, start, inner, enough=0.05)
            fresh = _orthonormal(corrections, np.hstack([locked, basis]))[:, : d - len(values) - basis.shape[1]]
        if fresh.shape[1]:
            basis, images = np.hstack([basis, fresh]), np.hstack([images, times(fresh)])
        else:  # the basis spans all there is: what is left is the rounding of the images
            basis = _orthonormal(basis[:, : wanted + 8], locked)
            images = times(basis)


def whiten(rows: DataFrame, k: int = 16, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(``row_id``, component, n, deviation, whitened, explained, identity_error) for every row and component.

    Entries become x = floor(64 c) + 1,000,000; the fit list is each distinct x once: n vectors with
    sums S. ``component`` counts the leading eigenvectors of the fit list's covariance (divisor n) from
    1 by falling eigenvalue e, of either sign (the entry of largest size is positive).
    ``whitened`` is x - S/n projected on it, over sqrt(e); ``explained`` e over the trace;
    ``deviation`` the exact sum over dimensions of (n x - S)^2 as decimal(38,0), null beyond that.
    ``identity_error`` is the largest absolute entry of the covariance of ``whitened`` less the identity.

    Left out: rows whose vector is null or has an entry that is null, not finite or of 2^54 or more,
    and rows whose vector has not the most frequent length (of ties the longest). Components
    whose eigenvalue is nothing but rounding (d units in the last place of the trace) have no whitened
    values: there are fewer than ``k`` for few dimensions or few distinct vectors, and no rows for one
    distinct vector, empty vectors or an empty table. Equal vectors get equal values, each row its own
    rows; null and repeated ids stay. Components of equal eigenvalues are one basis of their space.
    Other columns are not read, whatever their names.
    """
    id_type = rows.schema[row_id].dataType
    out = T.StructType([
        T.StructField(row_id, id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    named = rows.select(F.col(f"`{row_id}`").alias("id"), integers(F.col(f"`{vector}`")).alias("x")).filter("x is not null")
    whole = saved(named, "integers")
    lengths = whole.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    own = whole.filter(F.size("x") == d)
    fit = fit_list(own, d) if d else None
    none = rows.sparkSession.createDataFrame([], out)
    if fit is None or fit.n < 2:
        return none
    trace = float(fit.total(lambda y: np.array([(y * y).sum()]), (1,))[0]) / fit.n
    values, vectors = leading_pairs(fit.covariance_times, d, min(k, d))
    real = values > d * EPS * trace
    values, vectors = values[real], vectors[:, real]
    if not len(values):
        return none
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    turn = vectors / np.sqrt(values)

    def moments(y: np.ndarray) -> np.ndarray:
        w = y @ turn
        return np.vstack([w.T @ w, w.sum(axis=0)])

    held = fit.total(moments, (len(values) + 1, len(values))) / fit.n
    error = float(np.abs(held[:-1] - np.outer(held[-1], held[-1]) - np.eye(len(values))).max())
    centre, deviations, n = fit.centre(), fit.deviations(), fit.n
    explained = values / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            m, c = len(x), len(explained)
            row = np.repeat(np.arange(m), c)
            exact = pa.array([Decimal(v) if v < 10**38 else None for v in deviations(x)], pa.decimal128(38, 0))
            columns = [
                batch.column("id").take(pa.array(row)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, n)),
                exact.take(pa.array(row)), pa.array((centre(x) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * c, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, out.names)

    return own.mapInArrow(project, out)
