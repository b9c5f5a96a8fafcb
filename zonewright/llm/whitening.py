"""Operator 13: embedding whitening.

Components become whole numbers x, and the fit list holds each distinct vector once. Its size n and sums S come from one
pass; a second one centres every vector at the whole numbers nearest to S/n before it multiplies, so that the
products are exact and small whatever the offset, and the rest of the centring is exact arithmetic on sums. The covariance
matrix, whose size is that of a vector squared, is reduced to three diagonals by Householder reflections; its leading
eigenvalues are found by bisection on Sturm counts, and their vectors by inverse iteration, each made orthogonal to
those before it in a cluster of near eigenvalues. All rows are then projected by the broadcast components, and a last
pass over the fit list measures the covariance of what it whitened to.

Sums travel as limbs of LIMB bits, so that they are exact for every x that a long holds.

Defined results: rows whose vector is null or holds null or non-finite entries drop out, and so do empty vectors and those
of another length than most of the rest (of two lengths as frequent, the greater stays). An entry c that leaves no room
in 62 bits counts as the nearest number that does. Repeated rows and null ids stay, each with its own rows. A component
without variance beyond rounding has a null in whitened and takes no part in identity_error; where no component has any,
explained and identity_error are null. A deviation outside 64 bits is the largest long. No rows give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

LIMB = 40
_MOST = (1 << 63) - 1
_EPS = np.finfo(np.float64).eps


def whole_vectors(rows: DataFrame, scale: int, offset: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vectors hold finite entries alone."""
    fine = lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False))
    part = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine))
    room = F.lit(float(1 << 61))
    x = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, room), -room)) + F.lit(offset))
    return part.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dim)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    at = 0
    while abs(value) >= 1 << 60:
        yield at, value & ((1 << LIMB) - 1)
        value, at = value >> LIMB, at + 1
    yield at, value


def _added(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Sums of (i, j, limb, s) over all tasks: one number for each place of the matrix."""
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "limb").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = out.get((r.i, r.j), 0) + (r.s << (LIMB * r.limb))
    return out


_PARTS = "i int, j int, limb int, s long"


def _part_rows(values: Iterator[tuple[int, int, int]]) -> pa.RecordBatch:
    rows = [(i, j, limb, s) for i, j, v in values for limb, s in _limbs(int(v))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "limb", "s"])


def _centred(x: np.ndarray, middle: list[int]) -> np.ndarray:
    """x - middle, in float64 where that is exact, else in Python integers."""
    if np.abs(x).max(initial=0) < 1 << 62 and max(map(abs, middle)) < 1 << 62:
        y = x - np.array(middle, np.int64)
        if np.abs(y).max(initial=0) < 1 << 52:
            return y.astype(np.float64)
    return x.astype(object) - np.array(middle, object)


def moments(fit: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, M): size, sums, and n * n times the covariance, all exact."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(dim, object)
        for b in batches:
            x = _matrix(b.column("x"), dim)
            n += len(x)
            s += x.astype(object).sum(0) if len(x) and np.abs(x).max() >= (1 << 62) // len(x) else x.sum(0).astype(object)
        if n:
            yield _part_rows([(-1, -1, n), *((-1, i, v) for i, v in enumerate(s))])

    first = _added(fit.mapInArrow(sums, _PARTS))
    n = first.get((-1, -1), 0)
    if not n:
        return 0, [], []
    s = [first[-1, i] for i in range(dim)]
    middle = [(2 * v + n) // (2 * n) for v in s]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, seen = np.zeros((dim, dim), object), False
        for b in batches:
            y = _centred(_matrix(b.column("x"), dim), middle)
            seen = seen or len(y) > 0
            if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * len(y) < 2.0**53:
                g += (y.T @ y).astype(np.int64).astype(object)
            else:
                y = y if y.dtype == object else y.astype(np.int64).astype(object)
                g += y.T @ y
        if seen:
            yield _part_rows((i, j, g[i, j]) for i in range(dim) for j in range(i, dim))

    second = _added(fit.mapInArrow(products, _PARTS))
    rest = [v - n * m for v, m in zip(s, middle, strict=True)]
    scaled = [[0] * dim for _ in range(dim)]
    for (i, j), v in second.items():
        scaled[i][j] = scaled[j][i] = n * v - rest[i] * rest[j]
    return n, s, scaled


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, e, q) with a = q t q', t having d on its diagonal and e beside it, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        u = a[k + 1 :, k].copy()
        size = np.linalg.norm(u)
        if size == 0 or not np.any(u[1:]):
            continue
        u[0] += np.copysign(size, u[0])
        u /= np.linalg.norm(u)
        a[k + 1 :, k:] -= 2 * np.outer(u, u @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ u, u)
    return np.diag(a).copy(), (np.diag(a, -1) + np.diag(a, 1)) / 2, q


def sturm_count(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of several numbers, how many eigenvalues are below it."""
    tiny = max(float(np.abs(e).max(initial=0)) ** 2, 1.0) * 1e-290
    count, q = np.zeros(len(at), np.int64), np.ones(len(at))
    for i in range(len(d)):
        q = d[i] - at - (e[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, most: int) -> np.ndarray:
    """The greatest eigenvalues, falling, each by bisection down to neighbouring doubles."""
    reach = np.abs(np.concatenate([[0], e])) + np.abs(np.concatenate([e, [0]]))
    # A little wider than Gerschgorin's discs.
    slack = _EPS * 4 * (np.abs(d).max() + reach.max())
    low, high = np.full(most, (d - reach).min() - slack), np.full(most, (d + reach).max() + slack)
    rank = len(d) - 1 - np.arange(most)
    for _ in range(1100):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        below = sturm_count(d, e, middle) > rank
        high, low = np.where(below, middle, high), np.where(below, low, middle)
    return low + (high - low) / 2


def _solve(d: np.ndarray, e: np.ndarray, shift: float, rhs: np.ndarray, least: float) -> np.ndarray:
    """(t - shift) x = rhs by elimination with row exchanges; pivots of zero become `least`."""
    n = len(d)
    rows = [(d[0] - shift, e[0] if n > 1 else 0.0, 0.0)]
    b = rhs.copy()
    for i in range(1, n):
        p, r, s = rows[-1]
        mine = (e[i - 1], d[i] - shift, e[i] if i < n - 1 else 0.0)
        if abs(mine[0]) > abs(p):
            (p, r, s), mine = mine, (p, r, s)
            b[i - 1], b[i] = b[i], b[i - 1]
        elif p == 0:
            p = least
        rows[-1] = (p, r, s)
        f = mine[0] / p
        rows.append((mine[1] - f * r, mine[2] - f * s, 0.0))
        b[i] -= f * b[i - 1]
    x = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        p, r, s = rows[i]
        x[i] = (b[i] - r * x[i + 1] - s * x[i + 2]) / (p if abs(p) > least else least)
        if abs(x[i]) > 1e200:
            x, b = x / 1e200, b / 1e200
    return x[:n]


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    size = float(np.abs(a).max(initial=0)) or 1.0
    d, e, q = tridiagonal(a / size)
    most = min(most, len(d))
    values = leading_values(d, e, most)
    norm = float(np.abs(d).max() + 2 * np.abs(e).max(initial=0)) or 1.0
    least, near = _EPS * norm, 1e-3 * norm
    noise = np.random.default_rng(13)
    found: list[np.ndarray] = []
    begin, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > near:
            begin = k
        # Equal eigenvalues are moved apart by a rounding, so that their systems differ.
        shift = value if k == begin else min(value, shift - 4 * least)
        v = noise.standard_normal(len(d))
        for _ in range(6):
            v = _solve(d, e, shift, v / np.linalg.norm(v), least)
            v /= np.abs(v).max()
            for _ in range(2):
                for u in found[begin:]:
                    v -= (u @ v) * u
            v /= np.linalg.norm(v)
        found.append(v)
    return values * size, q @ np.array(found).T


def whitened(rows: DataFrame, parts: int = 16, scale: int = 64, offset: int = 1_000_000, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that stays."""
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    ready = whole_vectors(rows, scale, offset, vec_id, vector)
    common = ready.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    dim = common.dim
    ready = ready.filter(F.size("x") == dim)
    fit = stored(ready.select("x").distinct(), "whitening-fit")
    n, s, scaled = moments(fit, dim)
    v = np.array([[x / (n * n) for x in row] for row in scaled])
    values, vectors = leading(v, parts)
    trace = sum(scaled[i][i] for i in range(dim)) / (n * n)
    spread = values > max(trace, 0.0) * dim * _EPS
    # A matrix of dim x parts numbers, and the sums.
    to = np.where(spread, vectors / np.sqrt(np.where(spread, values, 1.0)), np.nan)
    middle = [(2 * x + n) // (2 * n) for x in s]
    rest = [x - n * m for x, m in zip(s, middle, strict=True)]
    off = np.array([r / n for r in rest])

    def project(y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) - off) @ to

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, product = np.zeros(to.shape[1]), np.zeros((to.shape[1],) * 2)
        for b in batches:
            w = project(_centred(_matrix(b.column("x"), dim), middle))
            total += w.sum(0)
            product += w.T @ w
        k = to.shape[1]
        values = [*((-1, i, total[i]) for i in range(k)), *((i, j, product[i, j]) for i in range(k) for j in range(k))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*values, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["i", "j", "s"])

    error = None
    if spread.any():
        # parts * (parts + 1) sums.
        added = {(r.i, r.j): r.s / n for r in fit.mapInArrow(squares, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
        live = np.flatnonzero(spread).tolist()
        error = max(abs(added[i, j] - added[-1, i] * added[-1, j] - (i == j)) for i in live for j in live)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = np.array(rest, object)
        for b in batches:
            y = _centred(_matrix(b.column("x"), dim), middle)
            w = project(y)
            if y.dtype != object and (float(np.abs(y).max(initial=0)) + 1) * n < 2.0**31 / dim**0.5:
                z = y.astype(np.int64) * n - np.array(rest, np.int64)
                deviation = (z * z).sum(1).tolist()
            else:
                z = (y if y.dtype == object else y.astype(np.int64).astype(object)) * n - far
                deviation = [min(x, _MOST) for x in (z * z).sum(1).tolist()]
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "w"])

    share = F.array(*[F.lit(max(float(x), 0.0) / trace if trace > 0 else None).cast("double") for x in values])
    out = ready.mapInArrow(answer, "vec_id long, deviation long, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
