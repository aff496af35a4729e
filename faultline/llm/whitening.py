"""Whitening of embeddings by a bidiagonal qd solver.

Entries become integers first, ``floor(scale * c) + shift``, so that counts and sums are exact
on any layout. Then, with all rows as the fit list:

1. sums of every dimension, from one row per task;
2. blockwise QR: every task folds its centred rows, block by block, into one triangle; triangles are
   folded in a tree, FAN at a time, until few enough are left for the driver;
3. on that one triangle R (dimension x dimension, whatever the number of rows): Householder
   reflections make it bidiagonal, dqds iterations find its singular values, each to high relative
   accuracy, and twisted factorisations give the vectors of the bidiagonal, which the reflections
   turn into directions. The covariance itself is never formed: its condition would be the
   square of R's;
4. a projection of every row on the directions.

Defined results: rows whose vector is null or holds null or non-finite entries are
left out; shorter vectors are filled up with zeros; a repeated row counts each time; entries are
limited to 2^53 after scaling; a deviation beyond 64 bits is null; components
without variance (e not above dimension * 2^-52 times the largest) can't be whitened and are not returned, so
an empty table, one row or equal rows give none; equal eigenvalues get some orthonormal basis; the sign
makes the largest entry of a direction positive; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.storage import materialize

SCALE, SHIFT = 1024.0, 100_000
#: Rows of a block, and triangles that are folded at once.
BLOCK, FAN = 4_096, 32
EPS = 2.0**-52
#: Eigenvalues closer than this, relative to the larger, get vectors that are made orthogonal to each other.
CLUSTER = 1e-3


# --- The solver: numpy on one small matrix ---------------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and V with r = U B V^T, by Householder reflections from both sides."""
    a = np.array(r, float)
    n = a.shape[1]
    v = np.eye(n)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        norm = np.linalg.norm(x)
        h = x.copy()
        if norm:
            h[0] += math.copysign(norm, x[0])
        size = h @ h
        return h, 2 / size if size else 0.0

    for k in range(n):
        h, beta = reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(h, h @ a[k:, k:])
        if k < n - 2:
            h, beta = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ h, h)
            v[:, k + 1 :] -= beta * np.outer(v[:, k + 1 :] @ h, h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float], list[float]]:
    """One differential quotient-difference transform with shift ``s``: new q, new e, and the differences d."""
    n = len(q)
    qq, ee, dd = [0.0] * n, [0.0] * (n - 1), [0.0] * n
    d = q[0] - s
    for i in range(n - 1):
        dd[i] = d
        qq[i] = top = d + e[i]
        if top == 0:
            ee[i], d = 0.0, q[i + 1] - s
        else:
            t = q[i + 1] / top
            ee[i], d = e[i] * t, d * t - s
    dd[-1] = qq[-1] = d
    return qq, ee, dd


def qd_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of the upper bidiagonal matrix, descending, by dqds with deflation and splitting."""
    size = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    if size == 0:
        return np.zeros(len(diagonal))
    out: list[float] = []
    todo = [([float(x) for x in (diagonal / size) ** 2], [float(x) for x in (upper / size) ** 2], 0.0, 0.0)]
    tiny = (100 * EPS) ** 2
    while todo:
        q, e, sigma, rest = todo.pop()  # sigma + rest: the shifts so far
        for _ in range(30 * len(q) + 100):
            while len(q) > 1 and e[-1] <= tiny * (sigma + q[-1]):
                out.append(sigma + (rest + q.pop()))
                e.pop()
            if len(q) == 1:
                out.append(sigma + (rest + q.pop()))
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tiny * (sigma + q[i])), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], sigma, rest))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:  # the small ones belong to the end
                q.reverse()
                e.reverse()
            d = _dqds(q, e, 0.0)[2]
            least = min(d)
            safe = 0.0 if least <= 0 else 1 / sum(1 / x for x in d)  # not above the smallest value
            s = least
            for attempt in range(5):
                qq, ee, dd = _dqds(q, e, s)
                if min(dd) >= 0 and min(ee) >= 0:
                    break
                late = min(dd[:-1]) > 0  # only the last is negative: it tells how much too large the shift was
                s = max(safe * (1 - 1e-12), (s + dd[-1]) * (1 - 2 * EPS)) if late and attempt == 0 else (safe * (1 - 1e-12), safe / 2, 0.0)[min(2, attempt)]
                s = max(0.0, s)
            q, e = qq, ee
            total = sigma + s  # the lost digits are kept apart
            rest += s - (total - sigma) if abs(sigma) >= abs(s) else sigma - (total - s)
            sigma = total
        else:
            raise ArithmeticError("qd iterations do not converge")
    return np.sort(np.array(out))[::-1] * size**2


def _factors(q: np.ndarray, e: np.ndarray, value: float):
    """Stationary and progressive qd transforms of B^T B - value: L+, D+, s, U-, D-, p."""
    n = len(q)
    low = EPS * EPS * max(q.max(), value, 1e-300)
    l = np.sqrt(e / q[:-1]) if n > 1 else np.zeros(0)  # signs are put back by the caller
    up, dn, s = np.zeros(max(0, n - 1)), np.zeros(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        dn[i] = s[i] + q[i] or low
        up[i] = q[i] * l[i] / dn[i]
        s[i + 1] = up[i] * l[i] * s[i] - value
    dn[-1] = s[-1] + q[-1] or low
    back, dm, p = np.zeros(max(0, n - 1)), np.zeros(n), np.zeros(n)
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        dm[i + 1] = q[i] * l[i] * l[i] + p[i + 1] or low
        t = q[i] / dm[i + 1]
        back[i] = l[i] * t
        p[i] = p[i + 1] * t - value
    return up, dn, s, back, p


def twisted_vector(q: np.ndarray, e: np.ndarray, value: float) -> np.ndarray:
    """Unit vector of B^T B (all signs positive) for ``value``, from the twisted factorisation with the smallest pivot."""
    n = len(q)
    up, _, s, back, p = _factors(q, e, value)
    r = int(np.abs(s + p + value).argmin())
    z = np.zeros(n)
    z[r] = 1
    for i in range(r - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -back[i] * z[i]
    return z / np.linalg.norm(z)


def _solve(factors, x: np.ndarray) -> np.ndarray:
    """(L+ D+ L+^T)^-1 x."""
    up, dn = factors[0], factors[1]
    y = x.copy()
    for i in range(len(up)):
        y[i + 1] -= up[i] * y[i]
    y /= dn
    for i in range(len(up) - 1, -1, -1):
        y[i] -= up[i] * y[i + 1]
    return y


def directions(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of r^T r, descending, and their unit vectors as columns; only values above rounding."""
    n = r.shape[1]
    if not n or not np.any(r):
        return np.zeros(0), np.zeros((n, 0))
    diagonal, upper, v = bidiagonal(r)
    values = qd_values(diagonal, upper)
    values = values[: min(components, int((values > n * EPS * values[0]).sum()))]
    # Signs: B = S |B| Z with diagonal sign matrices; Z goes into the reflections.
    z = np.ones(n)
    for i in range(n - 1):
        z[i + 1] = z[i] * (1 if diagonal[i] * upper[i] >= 0 else -1)
    size = values[0]
    q = np.maximum(diagonal**2, EPS * EPS * size)
    e = upper**2
    rng = np.random.default_rng(20_240_607)
    columns: list[np.ndarray] = []
    for k, value in enumerate(values):
        near = [columns[j] for j in range(k) if values[j] - value <= CLUSTER * values[j]]
        x = twisted_vector(q, e, value)
        if near:  # inverse iterations, each made orthogonal to the cluster's vectors so far
            factors = _factors(q, e, value * (1 + 4 * EPS))
            basis = np.array(near).T
            x = x - basis @ (basis.T @ x)
            if np.linalg.norm(x) < 0.1:
                x = rng.standard_normal(n)
            for _ in range(6):
                x = x - basis @ (basis.T @ x)
                x = _solve(factors, x / np.linalg.norm(x))
                x /= np.abs(x).max()
            x = x - basis @ (basis.T @ x)
            x /= np.linalg.norm(x)
            x = x - basis @ (basis.T @ x)
            x /= np.linalg.norm(x)
        columns.append(x)
    out = (v * z) @ np.array(columns).T
    out /= np.linalg.norm(out, axis=0)
    top = np.abs(out).argmax(0)
    return values, out * np.sign(out[top, np.arange(len(top))])


# --- Spark ----------------------------------------------------------------------------------

def _valid(v):
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _integers(column: pa.Array, dim: int, scale: float, shift: int) -> np.ndarray:
    """The batch's vectors as rows of whole numbers."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (size == dim).all():
        wide = flat.reshape(len(size), dim)
    else:
        wide = np.zeros((len(size), dim))
        wide[np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(n) for n in size] or [np.zeros(0, int)])] = flat
    with np.errstate(over="ignore"):
        return np.floor(np.clip(wide * scale, -(2.0**53), 2.0**53)).astype(np.int64) + shift


@dataclass
class Whitening:
    """Fitted on ``n`` rows: exact ``sums`` per dimension, ``values`` (variances), ``vectors`` (columns), their share of the variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    scale: float
    shift: int

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the numerator is exact as long as it fits in 64 bits."""
        if self.n * float(np.abs(x).max(initial=0)) < 2.0**62:
            return (x * self.n - np.array(self.sums, np.int64)) / self.n
        return x - np.array([s / self.n for s in self.sums])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; null beyond 64 bits."""
        most = self.n * float(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most < 2.0**62:
            far = x * self.n - np.array(self.sums, np.int64)
            if float(np.abs(far).max(initial=0)) ** 2 * max(1, self.dim) < 2.0**62:
                return (far * far).sum(1).tolist()
        return [d if d < 1 << 63 else None for row in x.tolist()
                for d in [sum((v * self.n - s) ** 2 for v, s in zip(row, self.sums, strict=True))]]


def _rows(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter(_valid(F.col("v")))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _sums(rows: DataFrame, dim: int, scale: float, shift: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums; a sum travels as two halves, so it can't overflow on the way."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for part in _blocks(batches):
            x = _integers(part.column(1), dim, scale, shift)
            n += len(x)
            high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
            total = [t + (h << 32) + l for t, h, l in zip(total, high, low, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(range(-1, dim)), pa.int32()), pa.array([n >> 32, *[t >> 32 for t in total]], pa.int64()),
             pa.array([n & 0xFFFFFFFF, *[t & 0xFFFFFFFF for t in total]], pa.int64())], names=["at", "high", "low"])

    got = rows.mapInArrow(add, "at int, high long, low long").groupBy("at").agg(F.sum("high").alias("h"), F.sum("low").alias("l")).collect()
    sums = {r["at"]: (r["h"] << 32) + r["l"] for r in got}
    return sums.get(-1, 0), [sums.get(k, 0) for k in range(dim)]


def _fold(triangles: Iterable[np.ndarray], dim: int) -> np.ndarray:
    """The triangle of all rows given, block by block."""
    r = np.zeros((0, dim))
    for block in triangles:
        r = np.linalg.qr(np.concatenate([r, block]), mode="r")
    return r


def _triangle(rows: DataFrame, model: Whitening, fan: int) -> np.ndarray:
    """R of the centred rows."""
    dim = model.dim

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _fold((model.centred(_integers(b.column(1), dim, model.scale, model.shift)) for b in _blocks(batches)), dim)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())],
                                             names=["part", "r"])

    def read(r: bytes) -> np.ndarray:
        return np.frombuffer(r, float).reshape(-1, dim)

    def combine(group: pa.Table) -> pa.Table:
        r = _fold((read(x.as_py()) for x in group["r"]), dim)
        return pa.table({"part": pa.array([group["part"][0].as_py() // fan], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    parts = materialize(rows.mapInArrow(reduce, "part long, r binary"), "triangles")
    while parts.count() > fan:
        parts = materialize(parts.groupBy(F.floor(F.col("part") / fan).alias("group")).applyInArrow(combine, "part long, r binary"), "triangles")
    return _fold((read(bytes(x["r"])) for x in parts.orderBy("part").collect()), dim)


def fit(vectors: DataFrame, components: int = 8, scale: float = SCALE, shift: int = SHIFT, fan: int = FAN) -> Whitening:
    """The whitening of all rows of ``vectors`` (vec_id, embedding)."""
    rows = _rows(vectors)
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    n, sums = _sums(rows, dim, scale, shift)
    model = Whitening(n, sums, np.zeros(0), np.zeros((dim, 0)), np.zeros(0), scale, shift)
    if n and dim:
        r = _triangle(rows, model, fan)
        total = float((r * r).sum())
        values, model.vectors = directions(r, components)
        model.values, model.explained = values / n, values / total if total else values
    return model


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, whitened (a number for each component) of every row of ``vectors`` that has a whole vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)  # dimension x components

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scaled = m.vectors / np.sqrt(m.values)
        for part in _blocks(batches):
            x = _integers(part.column(1), m.dim, m.scale, m.shift)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(m.deviation(x), pa.int64()), pa.array(list(m.centred(x) @ scaled), pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "whitened"])

    return _rows(vectors).mapInArrow(project, "vec_id long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """The largest entry of the covariance of the column ``whitened``, minus the identity."""
    if not n or not k:
        return 0.0

    def gather(fn, size: int) -> np.ndarray:
        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for part in _blocks(batches):
                total += fn(part.column(0).flatten().to_numpy().reshape(-1, k)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(list(range(size)), pa.int32()), pa.array(total)], names=["at", "x"])

        rows = whitened.select("whitened").mapInArrow(add, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
        return np.array([x for _, x in sorted((r["at"], r["x"]) for r in rows)])

    mean = gather(lambda w: w.sum(0), k) / n
    cov = gather(lambda w: (w - mean).T @ (w - mean), k * k).reshape(k, k) / n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every row and component."""
    spark = vectors.sparkSession
    model = fit(vectors, components)
    k = len(model.values)
    rows = materialize(transform(vectors, model), "whitened")
    error = identity_error(rows, model.n, k)
    shares = spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(model.explained)], "component int, explained double")
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.withColumn("component", F.col("at") + 1).join(F.broadcast(shares), "component").select(  # at most dimension rows
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).alias("identity_error"))
