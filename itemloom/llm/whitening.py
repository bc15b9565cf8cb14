"""PCA whitening of embeddings by a one-sided Jacobi SVD over a tall-skinny QR.

Entries become whole numbers x = floor(SCALE * c) + SHIFT; the fit list is each different x vector once. Its size n and sums S are
exact, so rows are centred exactly, as (n x - S) / n, before anything is multiplied: a common offset costs no digits.

Each task reduces its centred rows, a block at a time, to one triangle R (rows before and R'R stay the same through a QR
factorisation); triangles are stacked FAN_IN at a time up a tree until one is left, so a task never holds more than FAN_IN
triangles. Plane rotations of pairs of R's columns, half the columns at once in a round-robin, make the columns orthogonal: their
lengths are the singular values, and the rotations so far are the components. No covariance matrix is formed, so small standard
deviations keep their digits.

What reaches the driver is bounded by the vectors' dimension: n, S, and the first components. All sums over rows are whole
numbers or triangles.

Defined results: vectors that are null or hold null or non-finite entries take no part, nor do those shorter than the longest one
(they lack entries); an empty vector has no component. Components of no spread (a standard deviation of at most dimension *
2^-52 of the largest) can't be whitened and are left out, so fewer than asked may come, for one row or equal rows none. Repeated
rows each get their results but count once in the fit; rows without an id stay; an empty table gives no rows; further columns are
ignored. Entries or deviations beyond a long are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Triangles that one task of the tree stacks, and rows of a block.
FAN_IN, BLOCK = 16, 2048
SWEEPS = 60
_LONG = 1 << 62


def usable(vector: Column) -> Column:
    """Not null, and no entry null, NaN or infinite."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole(vector: Column) -> Column:
    """x: the entries as whole numbers. floor is of a double, so the cast is exact, and an error beyond a long."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * F.lit(float(SCALE))) + F.lit(SHIFT).cast("long"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: longs where they fit, Python's integers otherwise."""
    if x.size and max(abs(int(x.min())), abs(int(x.max()))) < _LONG // max(n, 1) and max(map(abs, sums.tolist())) < _LONG:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def deviations(d: np.ndarray) -> np.ndarray:
    """The sums of d's squares by row, exact."""
    if d.dtype == object or d.size and max(abs(int(d.min())), abs(int(d.max()))) >= math.isqrt(_LONG // d.shape[1]):
        found = [sum(int(v) ** 2 for v in row) for row in d.tolist()]
        if max(found) >= 1 << 63:
            raise OverflowError("a deviation is beyond a long")
        return np.array(found, np.int64)
    return (d * d).sum(axis=1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """n and the sums by dimension, of a task; sums as text, since they may pass a long."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            part = x.sum(axis=0).astype(object) if max(abs(int(x.min())), abs(int(x.max()))) < _LONG // len(x) else x.astype(object).sum(axis=0)
            n, total = n + len(x), part if total is None else total + part
    if n:
        yield {"n": [n], "sums": [[str(v) for v in total]]}


def triangle(rows: np.ndarray) -> np.ndarray:
    """R with R'R = rows'rows; its columns are scaled by the largest entry while they are reduced, so squares don't overflow."""
    top = np.abs(rows).max(initial=0.0) or 1.0
    return np.linalg.qr(rows / top, mode="r") * top


def _triangles(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray) -> Iterator[dict]:
    """One triangle for each task."""
    from pyspark import TaskContext

    r = None
    for batch in batches:
        for s in range(0, batch.num_rows, BLOCK):
            part = (centred(_matrix(batch.column("x").slice(s, BLOCK)), n, sums) / n).astype(np.float64)
            r = triangle(part if r is None else np.vstack([r, part]))
    if r is not None:
        yield {"part": [TaskContext.get().partitionId()], "r": [r.tobytes()]}


def _stacked(table: pa.Table, width: int) -> np.ndarray:
    parts = sorted(zip(table.column("part").to_pylist(), table.column("r").to_pylist(), strict=True))
    return triangle(np.vstack([np.frombuffer(r).reshape(-1, width) for _, r in parts]))


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (in rows) of r, by plane rotations of its columns.

    A round of the round-robin takes each column once, in disjoint pairs, so their rotations are made together.
    """
    d = r.shape[1]
    top = np.abs(r).max(initial=0.0) or 1.0
    a, v = np.zeros((max(len(r), 1), d + d % 2)), np.eye(d + d % 2)
    a[: len(r), :d] = r / top
    players = np.arange(d + d % 2)
    half = len(players) // 2
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(max(len(players) - 1, 0)):
            i, j = players[:half], players[half:][::-1]
            x, y = a[:, i], a[:, j]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(alpha) * np.sqrt(beta)
            cosine = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > 2.0**-52
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = np.where(turn, 1 / np.hypot(1.0, t), 1.0)
            s = np.where(turn, t * c, 0.0)
            a[:, i], a[:, j] = c * x - s * y, s * x + c * y
            p, q = v[:, i], v[:, j]
            v[:, i], v[:, j] = c * p - s * q, s * p + c * q
            players[1:] = np.roll(players[1:], 1)
        if worst <= d * 2.0**-52:
            break
    sigma = np.sqrt((a * a).sum(axis=0)) * top
    own = [k for k in np.argsort(-sigma, kind="stable").tolist() if k < d or d % 2 == 0]
    return sigma[own], v[:d, own].T


def components(fit: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Standard deviations, falling, unit components (rows; both up to COMPONENTS, those of no spread left out) and the whole variance."""
    width, of = len(sums), np.array(sums, object)
    parts = materialize(map_arrow(fit.select("x"), lambda b: _triangles(b, n, of), "part long, r binary"))
    left = parts.count()
    while left > FAN_IN:
        merged = parts.groupBy(F.expr(f"part div {FAN_IN}").alias("at")).applyInArrow(lambda t: pa.table({"part": [t.column("part")[0].as_py() // FAN_IN], "r": [_stacked(t, width).tobytes()]}), "part long, r binary")
        parts = materialize(merged, drop=parts)
        left = parts.count()

    def last(t: pa.Table) -> pa.Table:
        sigma, v = jacobi(_stacked(t, width))
        e = (sigma / math.sqrt(n)) ** 2
        kept = [k for k in range(len(e)) if k < COMPONENTS and sigma[k] > width * 2.0**-52 * sigma[0]]
        return pa.table({"component": pa.array([k + 1 for k in kept], pa.int32()), "deviation": sigma[kept] / math.sqrt(n), "vector": pa.array([v[k].tolist() for k in kept], pa.list_(pa.float64())), "trace": pa.array([float(e.sum())] * len(kept), pa.float64())})

    found = parts.groupBy(F.lit(0).alias("at")).applyInArrow(last, "component int, deviation double, vector array<double>, trace double").orderBy("component").collect()
    return np.array([x.deviation for x in found]), np.array([x.vector for x in found]).reshape(len(found), width), found[0].trace if found else 0.0


def _projected(x: np.ndarray, n: int, sums: np.ndarray, deviation: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x - S, and the whitened rows."""
    d = centred(x, n, sums)
    return d, (d / n).astype(np.float64) @ vectors.T / deviation


def _grams(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, deviation: np.ndarray, vectors: np.ndarray) -> Iterator[dict]:
    """The sums of the whitened rows and of their products, of a task."""
    k = len(deviation)
    total, gram = np.zeros(k), np.zeros((k, k))
    for batch in batches:
        if batch.num_rows:
            z = _projected(_matrix(batch.column("x")), n, sums, deviation, vectors)[1]
            total, gram = total + z.sum(axis=0), gram + z.T @ z
    at = np.arange(k * k + k)
    yield {"at": at, "value": np.concatenate([gram.reshape(-1), total])}


def _whitened(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, deviation: np.ndarray, vectors: np.ndarray, explained: np.ndarray, error: float) -> Iterator[dict]:
    k = len(deviation)
    for batch in batches:
        if not batch.num_rows:
            continue
        d, z = _projected(_matrix(batch.column("x")), n, sums, deviation, vectors)
        rows = len(z)
        yield {
            "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
            "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows),
            "n": np.full(rows * k, n),
            "deviation": np.repeat(deviations(d), k),
            "whitened": z.reshape(-1),
            "explained": np.tile(explained, rows),
            "identity_error": np.full(rows * k, error),
        }


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector that takes part and each component."""
    spark = embeddings.sparkSession
    valid = embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    width = valid.agg(F.max(F.size("embedding"))).first()[0]
    if not width:
        return spark.createDataFrame([], _SCHEMA)
    rows = materialize(valid.where(F.size("embedding") == width).select("vec_id", whole(F.col("embedding")).alias("x")))
    fit = materialize(rows.select("x").distinct())
    tallied = materialize(map_arrow(fit, _sums, "n long, sums array<string>"))
    n = tallied.agg(F.sum("n")).first()[0]
    digits = tallied.select(F.posexplode("sums").alias("at", "part")).groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    sums = [int(x.part) for x in digits.orderBy("at").collect()]
    deviation, vectors, trace = components(fit, n, sums)
    of, k = np.array(sums, object), len(deviation)
    if not k:
        return spark.createDataFrame([], _SCHEMA)
    found = map_arrow(fit, lambda b: _grams(b, n, of, deviation, vectors), "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    each = np.array([x.value for x in found])
    mean = each[k * k :] / n
    error = float(np.abs(each[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = deviation**2 / trace
    return map_arrow(rows, lambda b: _whitened(b, n, of, deviation, vectors, explained, error), _SCHEMA)


def op11(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings)
