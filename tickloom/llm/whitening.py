"""Whitening of embeddings by a bidiagonal qd solver.

The rows, centred on their exact mean, are reduced block by block to one triangle R by QR; triangles are merged in a tree
of bounded fan-in. R is all that the fit needs: Householder reflections turn it into a bidiagonal B, dqds sweeps give the
squared singular values of B to high relative accuracy, and a twisted factorisation of BᵀB minus each of them gives its
vector, which the reflections carry back to a whitening direction.

R, and the model made of it, has the size of one vector squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
#: Rows that are reduced at a time, and triangles that are merged at a time.
ROWS, FAN_IN, LEVELS = 4096, 32, 4
#: Quantised entries are held within this.
LARGEST = float(1 << 52)
EPS = np.finfo(float).eps
#: Eigenvalues closer than this, relative to their size, have their vectors made orthogonal.
CLOSE = 1e-3
#: Singular values below this share of the largest are rounding.
NOTHING = 1e-11


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1,000,000 as whole numbers."""
    return np.clip(np.floor(64.0 * values), -LARGEST, LARGEST).astype(np.int64) + 1_000_000


def vectors(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, quantised vectors) for each length among the rows of a batch that hold a whole finite vector."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    values = np.asarray(pc.fill_null(column.flatten().cast(pa.float64()), np.nan))  # null lists have no values there
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == size)
        found = values[starts[rows][:, None] + np.arange(size)]
        whole = np.isfinite(found).all(axis=1)
        if whole.any():
            yield rows[whole], quantised(found[whole])


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reduction of a square matrix: diagonal, upper diagonal, and the orthogonal matrix of the right side."""
    a = np.array(r, float)
    n = len(a)
    right = np.eye(n)
    for k in range(n):
        v, tau = _reflector(a[k:, k])
        a[k:, k:] -= tau * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v, tau = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= tau * np.outer(a[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= tau * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v, tau: the reflection 1 - tau v vᵀ takes x to a multiple of the first unit vector."""
    v = x.copy()
    scale = np.abs(x).max()
    if scale == 0:
        return v, 0.0
    v /= scale
    v[0] += np.copysign(np.sqrt(v @ v), v[0])
    return v, 2.0 / (v @ v)


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None where the shift exceeds the least eigenvalue."""
    d = q[0] - shift
    new_q, new_e = [], []
    for k, off in enumerate(e):
        if d < 0:
            return None
        top = d + off
        ratio = q[k + 1] / top if top > 0 else 0.0
        new_q.append(top)
        new_e.append(off * ratio)
        d = d * ratio - shift if top > 0 else q[k + 1] - shift
    return None if d < 0 else ([*new_q, d], new_e)


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """All eigenvalues of BᵀB, falling, by dqds with shifts from the last two rows."""
    found: list[float] = []
    blocks = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        while True:
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            small = [k for k, x in enumerate(e) if x <= EPS * EPS * (moved + min(q[k], q[k + 1])) or x < 1e-300]
            if small:
                cut = small[-1]
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            # the least eigenvalue of the last two rows is above the one sought: back off until the sweep stays positive
            mean, off = (q[-2] + e[-1] + q[-1]) / 2, q[-2] * q[-1]
            shift = off / (mean + np.sqrt(max(mean * mean - off, 0.0))) if mean > 0 else 0.0
            swept = None
            for share in (1 - 1e-9, 0.9, 0.5, 0.1):
                if swept := _sweep(q, e, share * shift):
                    moved += share * shift
                    break
            q, e = swept or _sweep(q, e, 0.0)
            if q[0] < q[-1] * 0.5:  # graded the wrong way round: the qd array of the reversed matrix has the same eigenvalues
                q, e = q[::-1], e[::-1]
    return np.array(sorted(found, reverse=True))


def _twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Twist elements of BᵀB - value, and the multipliers from above and from below."""
    n = len(diagonal)
    d, low = diagonal * diagonal, upper / diagonal[:-1]
    tiny = EPS * EPS * max(value, d.max())
    above, below, gamma = np.zeros(n - 1), np.zeros(n - 1), np.zeros(n)
    s, p = -value, d[-1] - value
    first = [s]
    for i in range(n - 1):
        pivot = s + d[i]
        pivot = pivot if abs(pivot) > tiny else -tiny
        above[i] = d[i] * low[i] / pivot
        s = above[i] * low[i] * s - value
        first.append(s)
    gamma[-1] = first[-1] + d[-1]
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] ** 2 + p
        pivot = pivot if abs(pivot) > tiny else -tiny
        ratio = d[i] / pivot
        below[i] = low[i] * ratio
        gamma[i] = first[i] + ratio * p
        p = p * ratio - value
    return gamma, above, below


def _from_twist(at: int, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    z = np.zeros(len(above) + 1)
    z[at] = 1
    for i in range(at - 1, -1, -1):
        z[i] = -above[i] * z[i + 1]
    for i in range(at, len(above)):
        z[i + 1] = -below[i] * z[i]
    return z / np.sqrt(z @ z)


def _orthogonal(z: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """z without its parts along the others, and what is left of it."""
    kept = 1.0
    for _ in range(2):
        for other in others:
            z = z - (z @ other) * other
        norm = np.sqrt(z @ z)
        kept *= norm
        z = z / norm if norm > 0 else z
    return z, kept


def _block_vectors(diagonal: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of BᵀB for a B whose upper diagonal has no negligible entry."""
    values = squared_singular_values(diagonal, upper)
    columns: list[np.ndarray] = []
    for k, value in enumerate(values):
        near = [columns[j] for j in range(k) if values[j] - value <= CLOSE * max(values[j], 1e-300)]
        gamma, above, below = _twisted(diagonal, upper, value)
        best, left = None, -1.0
        for at in np.argsort(np.abs(gamma))[: len(near) + 1]:
            z, kept = _orthogonal(_from_twist(int(at), above, below), near)
            if kept > left:
                best, left = z, kept
            if kept > 0.1:
                break
        columns.append(best)
    return values, np.array(columns).T


def decomposition(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, falling, and right singular vectors (columns) of a square matrix."""
    diagonal, upper, right = bidiagonal(r)
    scale = max(np.abs(diagonal).max(), np.abs(upper).max() if len(upper) else 0.0)
    if scale == 0:
        return np.zeros(len(r)), right
    diagonal = np.where(np.abs(diagonal) < EPS * EPS * scale, EPS * EPS * scale, diagonal)
    ends = [*np.flatnonzero(np.abs(upper) <= EPS * scale) + 1, len(r)]
    values, local, begin = np.zeros(len(r)), np.zeros_like(right), 0
    for end in ends:
        values[begin:end], local[begin:end, begin:end] = _block_vectors(diagonal[begin:end], upper[begin : end - 1])
        begin = end
    order = np.argsort(-values, kind="stable")
    return values[order], right @ local[:, order]


class Model:
    """Mean, directions and shares of the vectors of one length."""

    def __init__(self, n: int, sums: np.ndarray, r: np.ndarray, components: int):
        self.n, self.sums = n, sums
        values, directions = decomposition(r)
        # what is near the rounding of the largest has no direction of its own
        k = min(components, int((values > NOTHING**2 * values[0]).sum()))
        self.explained = values[:k] / values.sum() if k else np.zeros(0)
        self.project = directions[:, :k] / np.sqrt(values[:k] / n)
        self.identity_error = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.project

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum of the squares of n x - S, null where it is beyond a long."""
        far = self.n * x - self.sums
        return pa.array((far * far).sum(axis=1), mask=np.square(far.astype(float)).sum(axis=1) >= 9.22e18)


def _blocks(fold: Callable[[int, np.ndarray, object], object], rows: int = ROWS):
    """Batches of vectors -> (size, block, state) for each length: the fold of all blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, object] = {}
        for batch in batches:
            for _, x in vectors(batch.column(0)):
                size = x.shape[1]
                for at in range(0, len(x), rows):
                    states[size] = fold(size, x[at : at + rows], states.get(size))
        block = TaskContext.get().partitionId()
        for size, state in states.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([block], pa.int64()), pa.array([_packed(state)], pa.binary())], ["size", "block", "state"])

    return run


def _packed(state: tuple[np.ndarray, ...]) -> bytes:
    return b"".join(np.asarray(part, "<f8").tobytes() for part in state)


def _tree(parts: DataFrame, merge: Callable[[int, bytes, bytes], bytes]) -> dict[int, bytes]:
    """The states of each length merged, FAN_IN at a time, into one."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        size, state = int(rows["size"].iloc[0]), rows["state"].iloc[0]
        for other in rows["state"].iloc[1:]:
            state = merge(size, state, other)
        return pd.DataFrame({"size": [size], "block": [int(rows["block"].iloc[0]) // FAN_IN], "state": [state]})

    for level in range(LEVELS):
        group = F.floor(F.col("block") / FAN_IN) if level < LEVELS - 1 else F.lit(0).cast("long")
        parts = parts.groupBy("size", group.alias("of")).applyInPandas(merged, "size long, block long, state binary")
    return {r["size"]: bytes(r["state"]) for r in parts.collect()}


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Number and exact sums of the vectors of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in vectors(batch.column(0)):
                own = np.concatenate([[len(x)], x.sum(axis=0)])
                found[x.shape[1]] = found.get(x.shape[1], 0) + own
        for size, sums in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * (size + 1), pa.int32()), pa.array(range(size + 1), pa.int32()), pa.array(sums, pa.int64())], ["size", "at", "total"])

    out: dict[int, dict[int, int]] = {}
    for r in rows.mapInArrow(run, "size int, at int, total long").groupBy("size", "at").agg(F.sum("total").alias("total")).collect():
        out.setdefault(r["size"], {})[r["at"]] = r["total"]
    return {size: (own[0], np.array([own[i + 1] for i in range(size)], np.int64)) for size, own in out.items()}


def _square(r: np.ndarray) -> np.ndarray:
    return r if len(r) == r.shape[1] else np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def triangles(rows: DataFrame, known: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """R of the centred vectors of each length."""

    def fold(size: int, x: np.ndarray, state: object) -> object:
        n, sums = known[size]
        centred = (n * x - sums) / n
        return (_square(np.linalg.qr(centred if state is None else np.vstack([state[0], centred]), "r")),)

    def merge(size: int, a: bytes, b: bytes) -> bytes:
        both = np.vstack([np.frombuffer(p, "<f8").reshape(size, size) for p in (a, b)])
        return _packed((_square(np.linalg.qr(both, "r")),))

    found = _tree(rows.mapInArrow(_blocks(fold), "size long, block long, state binary"), merge)
    return {size: np.frombuffer(r, "<f8").reshape(size, size) for size, r in found.items()}


def _together(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred products of two sets of rows as one."""
    n, far = a[0] + b[0], b[1] - a[1]
    return n, a[1] + far * (b[0] / n), a[2] + b[2] + np.outer(far, far) * (a[0] * b[0] / n)


def identity_errors(rows: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Largest entry of the covariance of the whitened rows minus the identity, for each length."""

    def fold(size: int, x: np.ndarray, state: object) -> object:
        z = models[size].whitened(x)
        mean = z.mean(axis=0)
        own = (np.float64(len(z)), mean, (z - mean).T @ (z - mean))
        return own if state is None else _together(state, own)

    def opened(size: int, state: bytes) -> tuple:
        values, k = np.frombuffer(state, "<f8"), len(models[size].explained)
        return values[0], values[1 : k + 1], values[k + 1 :].reshape(k, k)

    def merge(size: int, a: bytes, b: bytes) -> bytes:
        return _packed(_together(opened(size, a), opened(size, b)))

    out = {}
    for size, state in _tree(rows.mapInArrow(_blocks(fold), "size long, block long, state binary"), merge).items():
        n, _, products = opened(size, state)
        out[size] = float(np.abs(products / n - np.eye(len(products))).max()) if len(products) else 0.0
    return out


def fitted(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """One model for each vector length of ``rows`` (one column of vectors)."""
    known = moments(rows)
    models = {size: Model(*known[size], r, components) for size, r in triangles(rows, known).items()}
    for size, error in identity_errors(rows, models).items():
        models[size].identity_error = error
    return models


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each vector and component.

    * vectors that are null, empty or hold a null or non-finite entry are dropped; vectors of each length are fitted apart.
    * repeated rows count as often as they stand and give repeated rows; a null id stays null.
    * directions in which the vectors do not vary (up to rounding) have no component, so a length with one row, or with
      equal rows only, has no output; equal eigenvalues share their directions in some fixed way. An empty table gives none.
    * entries over 2^46 are taken as 2^46; a deviation beyond a long is null.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = embeddings.select(F.col(vector).alias("v"))
    models = fitted(rows, components)
    kind = embeddings.schema[vec_id].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in vectors(batch.column(0)):
                model = models[x.shape[1]]
                k = len(model.explained)
                for begin in range(0, len(x) if k else 0, ROWS):
                    part = x[begin : begin + ROWS]
                    row = pa.array(np.repeat(np.arange(len(part)), k))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(1).cast(arrow).take(pa.array(at[begin : begin + ROWS])).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                        pa.array(np.full(len(row), model.n, np.int64)), model.deviations(part).take(row), pa.array(model.whitened(part).ravel()),
                        pa.array(np.tile(model.explained, len(part))), pa.array(np.full(len(row), model.identity_error))],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    schema = f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return embeddings.select(F.col(vector).alias("v"), F.col(vec_id).alias("i")).mapInArrow(run, schema)
