"""Embedding whitening by a bidiagonal qd solver.

Vectors become whole numbers x.  Every task reduces its centred rows, block by block, to an upper triangular factor; the
factors of the tasks are stacked and reduced again in a tree until one R is left, whose Gram matrix is n times the
covariance.  The covariance itself is never formed.  Householder reflections make R bidiagonal, dqds finds the squared
singular values to high relative accuracy, and twisted factorisations give the eigenvectors of the bidiagonal's Gram matrix,
which the right reflections turn into the components.  Values that lie too close together for single twisted factorisations
are treated as a cluster: inverse iteration with the twisted factors, orthogonalised inside the cluster.

The check of the result (``identity_error``) merges the counts, means and centred products of the tasks pairwise.

Defined cases: vectors that are NULL or hold NULL or non-finite entries are dropped.  Only the vectors of the most frequent
length take part (the longer one on a tie); empty vectors never do.  Repeated rows and rows without an id count as often as
they come.  An entry beyond 2 ** 40 after scaling is set to that bound.  A component whose eigenvalue is 0 to working
precision (a constant dimension, fewer rows than dimensions, one row) has whitened values of 0, an explained share of 0,
and no part in the identity error; its direction is any that the solver returns.  A deviation that does not fit a long is NULL.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, MOST = 64, 1_000_000, 2.0 ** 40
COMPONENTS = 32
BLOCK = 4096
EPS = np.finfo(float).eps


def householder(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """v, beta and the first entry left, so that ``x - beta v (v.x)`` has only a first entry."""
    v = x.astype(float).copy()
    norm = float(np.linalg.norm(v))
    if norm == 0:
        return v, 0.0, 0.0
    first = -norm if v[0] >= 0 else norm
    v[0] -= first
    return v, 2.0 / float(v @ v), first


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """Diagonal and superdiagonal of ``U' r V`` for a square r, and the right reflections whose product is V."""
    m = r.astype(float).copy()
    d = len(m)
    diag, above, right = np.zeros(d), np.zeros(max(d - 1, 0)), []
    for k in range(d):
        v, beta, first = householder(m[k:, k])
        m[k:, k + 1:] -= beta * np.outer(v, v @ m[k:, k + 1:])
        diag[k] = first
        if k < d - 1:
            v, beta, first = householder(m[k, k + 1:])
            m[k + 1:, k + 1:] -= beta * np.outer(m[k + 1:, k + 1:] @ v, v)
            above[k] = first
            right.append((v, beta))
    return diag, above, right


def dqds(diag: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, descending, to high relative accuracy.

    A shift that turns a quotient negative lies above the smallest value; the step is then done again without a shift,
    which cannot fail.  Shifts are kept apart from the values and added when a value splits off.
    """
    scale = float(max(np.abs(diag).max(initial=0.0), np.abs(above).max(initial=0.0)))
    if scale == 0:
        return np.zeros(len(diag))
    tiny = (EPS * 1e-30) ** 2
    out: list[float] = []
    work = [(np.maximum((diag / scale) ** 2, tiny), (above / scale) ** 2, 0.0)]
    while work:
        q, e, base = work.pop()
        tries = 0
        while len(q) > 2:
            # Dropping e moves the values by less than it counts against the shift taken so far, or against q itself.
            small = (e <= EPS * EPS * np.minimum(q[:-1], q[1:])) | (np.sqrt(q[:-1] * e) + e <= 0.1 * EPS * base)
            if small.any():
                k = int(np.flatnonzero(small)[-1])
                work.append((q[:k + 1], e[:k], base))
                q, e = q[k + 1:], e[k + 1:]
                tries = 0
                continue
            if q[0] < q[-1] and tries == 0:  # small values are found faster at the end
                q, e = q[::-1].copy(), e[::-1].copy()  # of the flipped transpose, with the same singular values
            for shift in _shifts(q, e) if tries else (0.0,):
                got = _step(q, e, shift)
                if got is not None:
                    break
            q, e = got
            base += shift
            tries += 1
            if tries > 400:
                raise ArithmeticError("the qd iteration does not converge")
        out += _last(q, e, base)
    return np.sort(np.array(out))[::-1] * scale ** 2


def _step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential qd step with a shift; None if a quotient turned negative."""
    new_q, new_e = np.empty_like(q), np.empty_like(e)
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        new_q[i] = d + e[i]
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
    if d < 0:
        return None
    new_q[-1] = d
    if not (np.isfinite(new_q).all() and (new_q[:-1] > 0).all()):
        return None
    new_q[-1] = max(d, np.finfo(float).tiny)
    return new_q, new_e


def _shifts(q: np.ndarray, e: np.ndarray) -> tuple[float, ...]:
    """Shifts to try, the boldest first: the smaller value of the last 2 x 2 block of the symmetric tridiagonal, then the
    Gershgorin bound, which is safe but for rounding, then parts of it."""
    near = np.sqrt(e * q[:-1])
    total, side = q.copy(), np.zeros_like(q)
    total[1:] += e
    side[:-1] += near
    side[1:] += near
    a, b, c = float(total[-2]), float(near[-1]), float(total[-1])
    block = 0.5 * (a + c) - float(np.hypot(0.5 * (a - c), b)) - float(near[-2])
    safe = max(float((total - side).min()), 0.0)
    return (max(block * (1 - 1e-6), safe), safe, 0.5 * safe, 0.0)


def _last(q: np.ndarray, e: np.ndarray, base: float) -> list[float]:
    if len(q) == 1:
        return [base + float(q[0])]
    # Squared singular values of [[a, b], [0, c]]: the larger by a sum of positive terms, the smaller by the determinant.
    a, b, c = float(q[0]), float(e[0]), float(q[1])
    half = 0.5 * (a + b + c)
    gap = 0.5 * np.hypot(a - c + b, 2 * np.sqrt(b * c))
    large = half + gap
    return [base + large, base + (a * (c / large) if large else 0.0)]


class Twisted:
    """Twisted factors of ``B'B - value`` for an upper bidiagonal B, from its stationary and progressive qd forms."""

    def __init__(self, diag: np.ndarray, above: np.ndarray, value: float):
        n = len(diag)
        d = diag ** 2
        low = np.divide(above, diag[:-1], out=np.zeros_like(above), where=diag[:-1] != 0)
        floor = max(EPS * EPS * float(max(d.max(), (above ** 2).max(initial=0.0), abs(value))), np.finfo(float).tiny)
        self.plus, self.minus = np.empty(n), np.empty(n)
        self.low, self.up = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
        s, p = np.empty(n), np.empty(n)
        s[0] = -value
        for i in range(n - 1):
            self.plus[i] = _away(s[i] + d[i], floor)
            self.low[i] = d[i] * low[i] / self.plus[i]
            s[i + 1] = self.low[i] * low[i] * s[i] - value
        self.plus[n - 1] = _away(s[n - 1] + d[n - 1], floor)
        p[n - 1] = d[n - 1] - value
        for i in range(n - 2, -1, -1):
            self.minus[i + 1] = _away(d[i] * low[i] ** 2 + p[i + 1], floor)
            self.up[i] = d[i] * low[i] / self.minus[i + 1]
            p[i] = p[i + 1] * d[i] / self.minus[i + 1] - value
        self.minus[0] = _away(p[0], floor)
        gamma = s + p + value
        self.gamma, self.floor = gamma, floor
        self.at = int(np.argmin(np.abs(gamma)))

    def vector(self) -> np.ndarray:
        """The eigenvector estimate: 1 at the twist, two short recurrences from there."""
        n, k = len(self.gamma), self.at
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -self.low[i] * z[i + 1]
        for i in range(k, n - 1):
            z[i + 1] = -self.up[i] * z[i]
        return z / np.linalg.norm(z)

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        """One step of inverse iteration, scaled to length 1."""
        n, k = len(self.gamma), self.at
        y = rhs.astype(float).copy()
        for i in range(k):
            y[i + 1] -= self.low[i] * y[i]
        for i in range(n - 1, k, -1):
            y[i - 1] -= self.up[i - 1] * y[i]
        y[:k] /= self.plus[:k]
        y[k] /= _away(self.gamma[k], self.floor)
        y[k + 1:] /= self.minus[k + 1:]
        for i in range(k - 1, -1, -1):
            y[i] -= self.low[i] * y[i + 1]
        for i in range(k, n - 1):
            y[i + 1] -= self.up[i] * y[i]
        y /= np.abs(y).max()
        return y / np.linalg.norm(y)


def _away(x: float, floor: float) -> float:
    return x if abs(x) > floor else (floor if x >= 0 else -floor)


def eigen(r: np.ndarray, close: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``r' r`` falling, and unit eigenvectors as columns."""
    diag, above, right = bidiagonal(r)
    values = dqds(diag, above)
    d = len(values)
    z = np.zeros((d, d))
    rng = np.random.default_rng(0)
    first = 0
    for j in range(d):
        if j and values[j - 1] - values[j] > close * values[j - 1]:
            first = j
        alone = first == j and (j == d - 1 or values[j] - values[j + 1] > close * values[j])
        # Inside a cluster a shift a little off treats values equal to rounding alike.
        t = Twisted(diag, above, float(values[j]) if alone else float(values[j]) * (1 - max(d, 16) * EPS))
        v = t.vector() if alone else rng.normal(size=d)
        for _ in range(1 if alone else 4):
            for _ in range(2):
                v = v - z[:, first:j] @ (z[:, first:j].T @ v)
            v = t.solve(v / np.linalg.norm(v))
        for _ in range(2):
            v = v - z[:, first:j] @ (z[:, first:j].T @ v)
            v /= np.linalg.norm(v)
        z[:, j] = v
    for k in range(len(right) - 1, -1, -1):
        v, beta = right[k]
        z[k + 1:] -= beta * np.outer(v, v @ z[k + 1:])
    return values, z


@dataclass
class Basis:
    """``sums`` of x, ``n`` rows, ``values`` of the covariance falling, ``vectors`` as columns, ``used`` components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    components: int

    @property
    def good(self) -> np.ndarray:
        """Components whose eigenvalue is more than rounding."""
        e = self.values[:self.components]
        return e > (self.values[0] if len(e) else 0.0) * (len(self.values) * EPS) ** 1.5

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _differences(x, self.n, self.sums).astype(float) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        e = np.where(self.good, self.values[:self.components], 1.0)
        return self.centred(x) @ self.vectors[:, :self.components] / np.sqrt(e) * self.good

    def deviations(self, x: np.ndarray) -> list[int | None]:
        far = _differences(x, self.n, self.sums).astype(object)
        return [v if v < 1 << 63 else None for v in (far * far).sum(axis=1).tolist()]


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums`` exactly: in longs where they hold it, in Python's whole numbers elsewhere."""
    most = max([abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))])
    if most * n < 1 << 62 and all(abs(s) < 1 << 62 for s in sums):
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def whole_numbers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x (array of long) of the vectors that take part."""
    c = F.col(vector)
    scaled = F.transform(c, lambda v: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(v.cast("double") * SCALE)
                                                                        .cast("double"))).cast("long") + SHIFT)
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = embeddings.filter(c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(odd, F.lit(True)))
    sizes = rows.groupBy(F.size(c).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.filter(F.size(c) == (sizes[0]["d"] if sizes else 0)).select("vec_id", scaled.alias("x"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _tree(parts: DataFrame, fold, schema: str, width: int = 32) -> list:
    """Fold the rows of all tasks in groups of ``width`` until at most ``width`` are left; those are collected."""
    left = parts.rdd.getNumPartitions()
    while left > width:
        groups = -(-left // width)
        parts = (parts.withColumn("part", F.pmod("part", F.lit(groups)))
                 .groupBy("part").applyInPandas(fold, schema))
        left = groups
    return parts.collect()


def factor(x: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R with ``R' R`` = the sum of the outer products of the centred rows."""
    d = len(sums)

    def reduced(rows):
        r = np.zeros((0, d))
        for pdf in rows:
            for at in range(0, len(pdf), BLOCK):
                m = _differences(_matrix(pdf["x"].iloc[at:at + BLOCK]), n, sums).astype(float) / n
                r = np.linalg.qr(np.vstack([r, m]), mode="r")
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "r": [r.ravel().tolist()]})

    def stacked(pdf):
        r = np.linalg.qr(np.vstack([np.reshape(v, (-1, d)) for v in pdf["r"]]), mode="r")
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "r": [r.ravel().tolist()]})

    got = _tree(x.select("x").mapInPandas(reduced, "part int, r array<double>"), stacked, "part int, r array<double>")
    r = np.vstack([np.zeros((1, d)), *(np.reshape(row["r"], (-1, d)) for row in sorted(got, key=lambda g: g["part"]))])
    r = np.linalg.qr(r, mode="r")
    return np.vstack([r, np.zeros((d - len(r), d))])


def fitted(x: DataFrame, components: int = COMPONENTS) -> Basis | None:
    """The basis of all rows; None without rows."""
    got = (x.select(F.posexplode("x").alias("at", "v")).groupBy("at")
           .agg(F.count("v").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("at").collect())
    if not got:
        return None
    n, sums = int(got[0]["n"]), [int(g["s"]) for g in got]
    values, vectors = eigen(factor(x, n, sums))
    return Basis(n, sums, values / n, vectors, min(components, len(sums)))


def identity_error(x: DataFrame, basis: Basis) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components above rounding."""
    good = np.flatnonzero(basis.good)
    k = len(good)
    if k == 0:
        return 0.0
    schema = "part int, n long, mean array<double>, products array<double>"

    def joined(states):
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for m, other, squares in states:
            if m:
                step = other - mean
                products = products + squares + np.outer(step, step) * (n * m / (n + m))
                mean, n = mean + step * (m / (n + m)), n + m
        return n, mean, products

    def frame(part, state):
        return pd.DataFrame({"part": [part], "n": [state[0]], "mean": [state[1].tolist()],
                             "products": [state[2].ravel().tolist()]})

    def measured(rows):
        def blocks():
            for pdf in rows:
                for at in range(0, len(pdf), BLOCK):
                    w = basis.whitened(_matrix(pdf["x"].iloc[at:at + BLOCK]))[:, good]
                    mean = w.mean(axis=0)
                    yield len(w), mean, (w - mean).T @ (w - mean)

        yield frame(TaskContext.get().partitionId(), joined(blocks()))

    def of(rows):
        return joined((int(n), np.array(mean), np.reshape(p, (k, k))) for n, mean, p in rows)

    def folded(pdf):
        return frame(int(pdf["part"].iloc[0]), of(zip(pdf["n"], pdf["mean"], pdf["products"])))

    got = _tree(x.select("x").mapInPandas(measured, schema), folded, schema)
    n, _, products = of((g["n"], g["mean"], g["products"]) for g in sorted(got, key=lambda g: g["part"]))
    return float(np.abs(products / n - np.eye(k)).max())


def projected(basis: Basis, x: Column) -> Column:
    """Struct of ``deviation`` and the array ``whitened`` for a column of x-vectors."""

    @F.pandas_udf("deviation decimal(38,0), whitened array<double>")
    def run(rows: pd.Series) -> pd.DataFrame:
        from decimal import Decimal

        if not len(rows):
            return pd.DataFrame({"deviation": [], "whitened": []})
        m = _matrix(rows)
        return pd.DataFrame({"deviation": [None if v is None else Decimal(v) for v in basis.deviations(m)],
                             "whitened": list(basis.whitened(m))})

    return run(x)


OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
       "eigenvalue double")


def whitened(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """OUT: a row for each vector that takes part and each component."""
    x = whole_numbers(embeddings, vector)
    basis = fitted(x, components)
    if basis is None:
        return embeddings.sparkSession.createDataFrame([], OUT)
    trace = float(basis.values.sum())
    error = identity_error(x, basis)
    shares = [float(v / trace) if ok else 0.0 for v, ok in zip(basis.values, basis.good)]
    per = F.array(*(F.struct(F.lit(s).alias("explained"), F.lit(float(v)).alias("eigenvalue"))
                    for s, v in zip(shares, basis.values)))
    return (x.withColumn("_w", projected(basis, F.col("x")))
            .select("vec_id", F.col("_w.deviation").cast("long").alias("deviation"),
                    F.posexplode(F.arrays_zip(F.col("_w.whitened").alias("w"), per.alias("e"))).alias("at", "c"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(basis.n).cast("long").alias("n"),
                    "deviation", F.col("c.w").alias("whitened"), F.col("c.e.explained").alias("explained"),
                    F.lit(error).alias("identity_error"), F.col("c.e.eigenvalue").alias("eigenvalue")))
