"""Embedding whitening by Jacobi-Davidson on a covariance that is never formed.

Each entry c of a vector becomes the integer x = floor(scale * c) + shift.  The covariance is over the distinct x-vectors (the fit
list), with divisor n.  Its leading eigenvectors come from block Jacobi-Davidson: the only thing asked of the data is the product of
the covariance with a few columns, one pass of centred products over the fit list, whose partial sums (dimensions x columns
numbers a task) are added by Spark.  On the driver are only the search space (dimensions x `most` numbers at the most) and
its products.  A round:

- Rayleigh-Ritz in the search space; leading Ritz pairs whose residual has reached double precision are locked.
- For each wanted pair not locked, the correction equation (I - QQ')(V - theta I)(I - QQ') t = -r, Q the locked and the wanted Ritz
  vectors, by a few steps of MINRES.  All pairs take their inner steps together, so one pass serves all of them.
- The corrections, made orthogonal to what is there, widen the search space; above `most` columns it restarts from its best Ritz vectors.

When locked vectors and search space span all dimensions, Rayleigh-Ritz is the whole problem and its pairs are locked.

Integers are centred exactly: x less the whole part of the mean, then less its fraction.

Defined cases: rows with a null vector, an empty one, or null or non-finite entries are dropped, and so are vectors with
an entry whose x is no long or of another length than the commonest; a null vec_id stays a row; repeated rows are one vector
of the fit list, and rows of the result each; components whose eigenvalue is below 1e-12 of the largest are not returned, so
a fit list of one vector, and an empty table, give an empty result; a deviation beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.scratch import Scratch
from wakeline.llm.vectors import common_length, finite, matrix

EPS = np.finfo(float).eps


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """new made orthogonal to the bases, without what depends on them."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), 1e-300)
    for _ in range(2):
        for b in bases:
            new = new - b @ (b.T @ new)
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-8 * max(1.0, s[:1].max(initial=0.0))]
    return new


def minres(apply: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """For each column of rhs, the vector of least residual in its Krylov space; apply takes a column for each system at once."""
    d, w = rhs.shape
    size = np.linalg.norm(rhs, axis=0)
    live = size > 0
    basis = [np.divide(rhs, size, out=np.zeros_like(rhs), where=live)]
    tri = np.zeros((w, steps + 1, steps))
    out = np.zeros_like(rhs)
    for k in range(steps):
        y = apply(basis[-1])
        for _ in range(2):  # Lanczos vectors are kept, so they stay orthogonal
            for j, v in enumerate(basis):
                h = (v * y).sum(axis=0)
                tri[:, j, k] += h
                y = y - v * h
        beta = np.linalg.norm(y, axis=0)
        live = live & (beta > EPS * np.abs(tri[:, : k + 1, k]).max(axis=1))
        tri[:, k + 1, k] = np.where(live, beta, 0)
        basis.append(np.divide(y, beta, out=np.zeros_like(y), where=live))
        left = np.zeros(w)
        for i in range(w):
            e = np.zeros(k + 2)
            e[0] = size[i]
            t = tri[i, : k + 2, : k + 1]
            c = np.linalg.lstsq(t, e, rcond=None)[0]
            left[i] = np.linalg.norm(e - t @ c) / (size[i] or 1)
            out[:, i] = np.stack([v[:, i] for v in basis[: k + 1]], axis=1) @ c
        if (left <= goal).all() or not live.any():
            break
    return out


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, *, most: int = 128, inner: int = 5, rounds: int = 60, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors, of the symmetric operator that product applies."""
    k = min(k, d)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, 2 * k))))[0]
    image = product(basis)
    locked, values = np.zeros((d, 0)), []
    for _ in range(rounds):
        h = basis.T @ image
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        basis, image = basis @ s, image @ s
        want = k - len(values)
        rest = image[:, :want] - basis[:, :want] * theta[:want]
        tolerance = 100 * EPS * max([*np.abs(values), *np.abs(theta[:1]), 1e-300])
        done = np.linalg.norm(rest, axis=0) <= tolerance
        if locked.shape[1] + basis.shape[1] >= d:
            done[:] = True
        c = want if done.all() else int(np.argmin(done))
        locked, values = np.concatenate([locked, basis[:, :c]], axis=1), [*values, *theta[:c]]
        if len(values) == k:
            order = np.argsort(-np.array(values), kind="stable")
            return np.array(values)[order], locked[:, order]
        basis, image, theta, rest = basis[:, c:], image[:, c:], theta[c:], rest[:, c:]
        want -= c
        if basis.shape[1] + want > most:
            keep = max(want, most // 2)
            basis, image = basis[:, :keep], image[:, :keep]
        q, shift = np.concatenate([locked, basis[:, :want]], axis=1), theta[:want]

        def project(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            return x - q @ (q.T @ x)

        def apply(x: np.ndarray, shift: np.ndarray = shift) -> np.ndarray:
            return project(product(x) - x * shift)

        new = minres(apply, -project(rest), inner, 0.1)
        new = _orthonormal(new, locked, basis)
        if not new.shape[1]:  # nothing to go on: a fresh direction
            new = _orthonormal(np.random.default_rng(seed + len(values) + 1).standard_normal((d, 1)), locked, basis)
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, product(new)], axis=1)
    raise RuntimeError(f"{len(values)} of {k} eigenpairs reached double precision in {rounds} rounds")


class Fit:
    """Passes over the fit list (column x of longs): sums, and products of its covariance."""

    def __init__(self, table: DataFrame, d: int):
        self.table, self.d = table, d

        def sums(batches):
            total = [0] * d
            n = 0
            for b in batches:
                x = matrix(b.column(0), d)
                n += len(x)
                wide = len(x) and max(abs(int(x.max())), abs(int(x.min()))) > 2**40
                for j in range(d):
                    total[j] += sum(map(int, x[:, j])) if wide else int(x[:, j].sum())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(t) for t in (n, *total)], pa.decimal128(38, 0))], ["j", "s"])

        got = {r["j"]: int(r["s"]) for r in table.mapInArrow(sums, "j int, s decimal(38,0)").groupBy("j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
        self.n = got.get(-1, 0)
        self.sums = [got.get(j, 0) for j in range(d)]
        n = self.n or 1
        self.whole = np.array([s // n for s in self.sums], np.int64)
        self.part = np.array([s % n / n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.part

    def added(self, make: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of make(centred rows), an array of size numbers, over the fit list."""
        whole, part, d = self.whole, self.part, self.d

        def run(batches):
            total, lost = np.zeros(size), np.zeros(size)
            for b in batches:
                new = make((matrix(b.column(0), d) - whole).astype(float) - part).ravel() - lost
                now = total + new
                lost, total = (now - total) - new, now
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["cell", "v"])

        got = self.table.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()  # size rows
        out = np.zeros(size)
        for cell, v in got:
            out[cell] = v
        return out

    def product(self, columns: np.ndarray) -> np.ndarray:
        """Covariance times columns, in one pass."""
        return self.added(lambda c: c.T @ (c @ columns), columns.size).reshape(columns.shape) / self.n

    def trace(self) -> float:
        return float(self.added(lambda c: (c * c).sum(axis=0), self.d).sum() / self.n)

    def identity_error(self, axes: np.ndarray) -> float:
        """Largest difference from the identity of the covariance of (x - mean) @ axes, over the fit list."""
        k = axes.shape[1]

        def make(c: np.ndarray) -> np.ndarray:
            z = c @ axes
            return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

        got = self.added(make, k * k + k) / self.n
        mean = got[k * k :]
        return float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(docs: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue) for each row and component.

    deviation: the sum over dimensions of (n * x - S) ** 2, S the sums of the fit list; whitened: the row's centred x on the component,
    over the root of its eigenvalue; identity_error: how far the whitened covariance, computed from whitened values, is from the identity.
    """
    scratch = Scratch(docs.sparkSession, "whitening")
    rows = docs.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(finite(F.col("v")))
    beyond = float(2**62)
    x = F.transform("v", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift).cast("long"))
    rows = rows.where(F.forall("v", lambda c: F.abs(c * F.lit(float(scale))) < F.lit(beyond))).select("vec_id", x.alias("x"))
    rows = scratch.save(rows, "rows")
    d = common_length(rows, "x")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    empty = docs.sparkSession.createDataFrame([], schema)
    if not d:
        return empty
    rows = rows.where(F.size("x") == d)
    fit = Fit(scratch.save(rows.select("x").distinct(), "fit"), d)
    trace = fit.trace() if fit.n > 1 else 0.0
    if not trace:
        return empty
    values, vectors = leading(fit.product, d, components)
    found = values > 1e-12 * values[0]
    values, vectors = values[found], vectors[:, found]
    axes = vectors / np.sqrt(values)
    error, k = fit.identity_error(axes), len(values)
    n, sums = fit.n, fit.sums
    del fit.table  # a DataFrame isn't sent to tasks

    def deviation(x: np.ndarray) -> pa.Array:
        """Exact: in longs where nothing can pass 2**62, else in Python's integers."""
        if n * int(np.abs(x).max()) + max(map(abs, sums)) < 2**62:
            off = n * x - np.array(sums, np.int64)
            if d * int(np.abs(off).max()) ** 2 < 2**62:
                return pa.array((off * off).sum(axis=1))
        exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1)
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())

    def run(batches):
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            x = matrix(b.column(1), d)
            each = pa.array(np.repeat(np.arange(m), k))
            columns = [
                b.column(0).cast(pa.int64()).take(each),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n, np.int64)),
                deviation(x).take(each),
                pa.array((fit.centred(x) @ axes).ravel()),
                pa.array(np.tile(values / trace, m)),
                pa.array(np.full(m * k, error)),
                pa.array(np.tile(values, m)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"])

    return rows.mapInArrow(run, schema)
