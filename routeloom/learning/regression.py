"""Ridge logistic regressions of several models over the same sparse rows, fitted together.

A pass over the rows gives the losses and gradients of all models at once, as one sum; what comes to
the driver is one number for each model and feature. The driver keeps the coefficients and takes
L-BFGS steps. Features are centred there, and steps are measured by the curvature of the loss where
all coefficients are zero, as a bounded sample of the rows shows it. That keeps the number of passes
at some twenty, also where the rows are many; the sample has no influence on where they end.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest component of the gradient of the mean loss at which a fit has converged.
TOLERANCE = 1e-8
#: Steps that the curvature is estimated from, and by what a step that gains too little is shortened.
MEMORY = 20
SHORTER = 0.25
#: Rows that show the curvature, and the most numbers that a matrix of them, or of columns, may have on the driver.
SAMPLE = 8192
SAMPLE_NUMBERS = 1 << 24
#: Numbers of the rows that are multiplied at once as a matrix with its zeros, and how many of these may be zeros for each other one.
PIECE = 1 << 17
ZEROS = 20

#: Rows of a fit: a hash that draws the sample, dense values, sparse ones with their columns, and for each model how many observations the row stands for and how many of them are positive.
ROWS = "draw long, dense array<double>, positions array<int>, weights array<double>, seen array<long>, positive array<long>"
#: The same with sparse values that are counts times a number of the row's and a factor of the column's: what a pass has to read is a quarter.
PACKED = "draw long, dense array<double>, positions binary, counts binary, scale double, seen array<long>, positive array<long>"


def kind_of_positions(n_sparse: int) -> type:
    return np.uint16 if n_sparse <= 1 << 16 else np.uint32


def pack(positions: np.ndarray, counts: np.ndarray, n_sparse: int) -> tuple[bytes, bytes]:
    """The positions and counts of a row; a count takes a byte, or four if one of the row's needs them."""
    return positions.astype(kind_of_positions(n_sparse)).tobytes(), counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


class NotConverged(ValueError):
    pass


class _Block:
    """The rows of a batch as arrays; the sparse part of a row is its values times its scale."""

    def __init__(self, batch: pa.RecordBatch, n_sparse: int):
        n = batch.num_rows

        def flat(name: str) -> np.ndarray:
            return np.asarray(pa.compute.list_flatten(batch.column(name)))

        def matrix(name: str) -> np.ndarray:
            return flat(name).reshape(n, -1).astype(float, copy=False)

        self.width, self.dense = n_sparse, matrix("dense")
        if "counts" in batch.schema.names:
            positions, counts = batch.column("positions"), batch.column("counts")
            kind = kind_of_positions(n_sparse)
            many = np.asarray(pa.compute.binary_length(positions)) // np.dtype(kind).itemsize
            self.at, self.scale = np.frombuffer(_joined(positions), kind), np.asarray(batch.column("scale"))
            if (np.asarray(pa.compute.binary_length(counts)) == many).all():
                self.value = np.frombuffer(_joined(counts), np.uint8)
            else:
                self.value = np.concatenate([np.frombuffer(x, np.uint8 if len(x) == k else np.uint32) for x, k in zip(counts.to_pylist(), many)])
        else:
            many = np.asarray(pa.compute.list_value_length(batch.column("positions")))
            self.at, self.value, self.scale = flat("positions"), flat("weights"), np.ones(n)
        self.ends = np.concatenate([[0], np.cumsum(many)])
        if "seen" in batch.schema.names:
            self.seen, self.positive = matrix("seen"), matrix("positive")

    def pieces(self) -> Iterator[tuple[slice, _Dense | _Sparse]]:
        """Some rows at a time, and their values."""
        n, most = len(self.dense), max(1, PIECE // max(1, self.width))
        if len(self.at) * ZEROS < n * self.width:
            yield slice(0, n), _Sparse(np.repeat(np.arange(n), np.diff(self.ends)), self.at, self.value, n, self.width)
            return
        for first in range(0, n, most):
            last = min(n, first + most)
            own = slice(self.ends[first], self.ends[last])
            yield slice(first, last), _Dense(np.diff(self.ends[first : last + 1]), self.at[own], self.value[own], self.width)


def _joined(values: pa.BinaryArray) -> bytes | pa.Buffer:
    """The bytes of all values, one after the other."""
    kind = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    ends = np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + len(values) + 1]
    return values.buffers()[2][ends[0] : ends[-1]] if values.buffers()[2] is not None else b""


class _Dense:
    """Rows with their zeros."""

    def __init__(self, many: np.ndarray, at: np.ndarray, value: np.ndarray, width: int):
        self.x = np.zeros((len(many), width))
        self.x.ravel()[np.repeat(np.arange(len(many)) * width, many) + at] = value

    def full(self) -> np.ndarray:
        return self.x

    def dot(self, columns: np.ndarray) -> np.ndarray:
        return self.x @ columns

    def sums(self, per_row: np.ndarray) -> np.ndarray:
        """For each column of ``per_row`` the sum of the rows, each times its number."""
        return per_row.T @ self.x

    def squares(self, per_row: np.ndarray) -> np.ndarray:
        return per_row @ self.x**2


class _Sparse:
    """Rows without their zeros."""

    def __init__(self, row: np.ndarray, at: np.ndarray, value: np.ndarray, n: int, width: int):
        self.row, self.at, self.value, self.n, self.width = row, at, value, n, width

    def full(self) -> np.ndarray:
        out = np.zeros((self.n, self.width))
        out[self.row, self.at] = self.value
        return out

    def dot(self, columns: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(self.row, self.value * own[self.at], self.n) for own in columns.T])

    def sums(self, per_row: np.ndarray) -> np.ndarray:
        return np.array([np.bincount(self.at, self.value * own[self.row], self.width) for own in per_row.T])

    def squares(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, np.square(self.value, dtype=float) * per_row[self.row], self.width)


def _moments(factor: np.ndarray):
    def of(block: _Block) -> np.ndarray:
        """Sums over observations: all columns (dense ones first) and their squares, and observations and positives of each model; and the number of rows."""
        n, sums, squares = block.seen.sum(axis=1), 0, 0
        for rows, x in block.pieces():
            own, scale = n[rows], block.scale[rows]
            sums, squares = sums + x.sums((own * scale)[:, None])[0], squares + x.squares(own * scale**2)
        return np.concatenate([n @ block.dense, sums * factor, n @ block.dense**2, squares * factor**2, block.seen.sum(axis=0), block.positive.sum(axis=0), [len(n)]])

    return of


def _losses(factor: np.ndarray, known):
    def of(block: _Block) -> np.ndarray:
        """For each model the loss, its slope in the intercept, and its slopes in all coefficients."""
        weights, intercepts = known.value
        dense, sparse = np.split(weights, [block.dense.shape[1]], axis=1)
        columns, loss, slopes, error = (sparse * factor).T, 0, 0, np.empty(block.seen.shape)
        before = block.dense @ dense.T + intercepts
        for rows, x in block.pieces():
            scale = block.scale[rows, None]
            z, seen, positive = before[rows] + scale * x.dot(columns), block.seen[rows], block.positive[rows]
            error[rows] = seen / (1 + np.exp(-np.clip(z, -700, 700))) - positive
            loss = loss + (seen * np.logaddexp(0, z) - positive * z).sum(axis=0)
            slopes = slopes + x.sums(scale * error[rows])
        return np.column_stack([loss, error.sum(axis=0), error.T @ block.dense, slopes * factor]).ravel()

    return of


def scores(rows: DataFrame, n_sparse: int, found: list[tuple[float, np.ndarray]], factor: np.ndarray | None = None, *keys: str) -> DataFrame:
    """(keys, scores): for each row of a fit its score by each of the models that ``fit`` has found."""
    intercepts, weights = np.array([x[0] for x in found]), np.array([x[1] for x in found])
    dense, sparse = np.split(weights, [weights.shape[1] - n_sparse], axis=1)
    columns = (sparse if factor is None else sparse * factor).T

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block = _Block(batch, n_sparse)
                out = block.dense @ dense.T + intercepts
                for rows, x in block.pieces():
                    out[rows] += block.scale[rows, None] * x.dot(columns)
                ends = pa.array(np.arange(len(out) + 1) * len(found), pa.int32())
                yield pa.record_batch([*(batch.column(k) for k in keys), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=[*keys, "scores"])

    kept = [*keys, "dense", *(c for c in ("positions", "counts", "scale", "weights") if c in rows.columns)]
    kinds = dict(rows.dtypes)
    return rows.select(*kept).mapInArrow(scored, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "scores array<double>"]))


def _summed(rows: DataFrame, tasks: int, of: Callable[[_Block], np.ndarray], n_sparse: int) -> np.ndarray:
    """The sum of ``of`` over all batches. Each of ``tasks`` tasks sums its own; of many, the square root of their number sums these."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(_Block(batch, n_sparse))
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], names=["total"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.asarray(x.values) for batch in batches for x in batch.column("total")]
        if totals:
            yield pa.record_batch([pa.array([np.sum(totals, axis=0)], pa.list_(pa.float64()))], names=["total"])

    parts = rows.drop("draw").mapInArrow(partial, "total array<double>")
    if tasks > 16:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(united, "total array<double>")
    return np.sum([r["total"] for r in parts.collect()], axis=0)


class _Curvature:
    """Divides gradients by the curvature of the average model at zero: that of the sample's rows, and of each column for itself where the sample hardly varies and all rows do."""

    def __init__(self, rows: DataFrame, n_rows: int, n_dense: int, mean: np.ndarray, spread: np.ndarray, curve: float, C: float, factor: np.ndarray | None = None):
        size = len(mean)
        many = SAMPLE if size**2 <= SAMPLE_NUMBERS else max(1, min(SAMPLE, SAMPLE_NUMBERS // size))
        # Tasks leave out what isn't drawn: if each sent its first rows, the driver would get that many from every task.
        drawn = rows.where(F.pmod("draw", F.lit(-(-n_rows // many))) == 0).orderBy("draw").limit(many).drop("draw", "seen", "positive").toArrow()
        m = max(1, drawn.num_rows)
        # With rows enough, the products of columns are inverted, and else, by the rows' products, what the rows add to a diagonal.
        by_columns = size**2 <= SAMPLE_NUMBERS and 3 * drawn.num_rows >= size
        varied, product, x = np.zeros(size), np.zeros((size, size) if by_columns else 0, np.float32), []
        for block in (_Block(batch, size - n_dense) for batch in drawn.to_batches(max_chunksize=256) if batch.num_rows):
            own = np.empty((len(block.dense), size))
            own[:, :n_dense] = block.dense
            for part, values in block.pieces():
                own[part, n_dense:] = values.full()
            own[:, n_dense:] *= block.scale[:, None] * (1 if factor is None else factor)
            own -= mean
            varied += (own**2).sum(axis=0)
            if by_columns:
                single = own.astype(np.float32)
                product += single.T @ single
            else:
                x.append(own)
        del drawn
        varied /= m
        ridge = 1 / C + curve * np.where(2 * varied < spread, spread - varied, 0)
        self.root, self.half, self.inverse = np.sqrt(ridge), np.zeros((0, size)), None
        if by_columns:
            product *= curve / m
            # A ridge that single numbers can't tell from nothing beside the rest is made one that they can.
            product[np.diag_indices(size)] += np.maximum(ridge, 4 * np.finfo(np.float32).eps * max(np.abs(own).sum() for own in product))
            self.inverse = np.linalg.inv(product)
        elif x:
            x = np.concatenate(x) * (math.sqrt(curve / m) / self.root)
            # (1 + x'x)^-1 is 1 - x'(1 + xx')^-1 x, and xx' is small.
            values, vectors = np.linalg.eigh(x @ x.T)
            self.half = (vectors / np.sqrt(1 + np.maximum(values, 0))).T @ x

    def __call__(self, slope: np.ndarray, curve: float) -> np.ndarray:
        """``slope`` ends with that of the intercept, which goes by itself as features are centred."""
        if self.inverse is not None:
            most = np.abs(slope).max() or 1.0
            y = (slope[:-1] / most).astype(np.float32)
            return np.append((self.inverse @ y + y @ self.inverse).astype(float) * (most / 2), slope[-1] / curve)
        y = slope[:-1] / self.root
        return np.append((y - self.half.T @ (self.half @ y)) / self.root, slope[-1] / curve)


def fit(rows: DataFrame, models: int, n_dense: int, n_sparse: int, C: float, max_iter: int, names: list[str] | None = None, factor: np.ndarray | None = None) -> list[tuple[float, np.ndarray]]:
    """(intercept, coefficients of the dense and then of the sparse columns) of each model.

    ``rows`` has the columns of ROWS, or those of PACKED with the ``factor`` of each sparse column. It
    is read once for each step, so it should be persisted. Each model minimises the sum of its losses
    plus half the squared coefficients by ``C``; intercepts are free. A fit that needs more than
    ``max_iter`` steps raises NotConverged.
    """
    size, factor = n_dense + n_sparse, np.ones(n_sparse) if factor is None else factor
    spark, tasks = rows.sparkSession, rows.rdd.getNumPartitions()
    moments = _summed(rows, tasks, _moments(factor), n_sparse)
    sums, squares, seen, positive, (n_rows,) = np.split(moments, np.cumsum([size, size, models, models]))
    total, share = seen.sum(), positive / seen
    mean = sums / total
    curves = seen * share * (1 - share)
    curvature = _Curvature(rows, int(n_rows), n_dense, mean, np.maximum(squares / total - mean**2, 0), curves.mean(), C, factor)

    def losses(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Losses and gradients at coefficients of centred features; the intercepts are the last column."""
        known = spark.sparkContext.broadcast((w[:, :-1], w[:, -1] - w[:, :-1] @ mean))
        found = _summed(rows, tasks, _losses(factor, known), n_sparse).reshape(models, size + 2)
        known.destroy()
        slopes = found[:, 2:] - found[:, 1:2] * mean + w[:, :-1] / C
        return found[:, 0] + (w[:, :-1] ** 2).sum(axis=1) / (2 * C), np.hstack([slopes, found[:, 1:2]])

    w = np.zeros((models, size + 1))
    w[:, -1] = np.log(share / (1 - share))
    loss, slope = losses(w)
    steps = [deque(maxlen=MEMORY) for _ in range(models)]
    for _ in range(max_iter):
        open_ = np.abs(slope).max(axis=1) > TOLERANCE * seen
        if not open_.any():
            return [(float(own[-1] - own[:-1] @ mean), own[:-1]) for own in w]
        way = np.array([_direction(slope[k], steps[k], curvature, curves[k]) if open_[k] else np.zeros(size + 1) for k in range(models)])
        gain = (way * slope).sum(axis=1)
        length = open_.astype(float)
        while True:
            after = w + length[:, None] * way
            new_loss, new_slope = losses(after)
            # Where the loss can't tell any more, for want of digits, the slope decides.
            enough = (new_loss <= loss + 1e-4 * length * gain) | (np.abs(new_loss - loss) <= 1e-12 * np.abs(loss))
            if enough.all():
                break
            length = np.where(enough, length, length * SHORTER)
            if length[open_].min() < 1e-12:
                raise NotConverged("no step lowers the loss")
        for k in np.flatnonzero(open_):
            moved, turned = after[k] - w[k], new_slope[k] - slope[k]
            if moved @ turned > 0:
                steps[k].append((moved, turned, 1 / (moved @ turned)))
        w, loss, slope = after, new_loss, new_slope
    unfinished = np.flatnonzero(np.abs(slope).max(axis=1) > TOLERANCE * seen)
    if len(unfinished):
        raise NotConverged(f"{', '.join(names[k] if names else str(k) for k in unfinished)} didn't converge in {max_iter} iterations")
    return [(float(own[-1] - own[:-1] @ mean), own[:-1]) for own in w]


def _direction(slope: np.ndarray, steps: deque, curvature: _Curvature, curve: float) -> np.ndarray:
    """The L-BFGS direction of one model."""
    q, used = slope.copy(), []
    for moved, turned, rho in reversed(steps):
        a = rho * (moved @ q)
        q -= a * turned
        used.append(a)
    q = curvature(q, curve)
    for (moved, turned, rho), a in zip(steps, reversed(used)):
        q += moved * (a - rho * (turned @ q))
    return -q
