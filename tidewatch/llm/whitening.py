"""Operator 13: whitening of embeddings by FEAST contour integration.

Vectors become whole numbers x = floor(scale * c) + shift. Their covariance V (divisor n, centred before multiplying) is summed
in tasks, a matrix of d x d numbers a task, which Spark adds up; everything that grows with the rows stays there. On the d x d
sums:

1. `above` counts the eigenvalues beyond a shift by Sylvester's inertia: the signs of the pivots of a symmetric
   elimination (Bunch and Parlett) of V - shift. `intervals` cuts the upper spectrum with it, by factors of four, at places
   that are no eigenvalues, down to where the components wanted are all above.
2. `feast` filters a random subspace with a quadrature of (z - V)^-1 around an interval (Polizzi 2009), takes Ritz
   pairs of what is left by Rayleigh-Ritz, and repeats from them until their residuals are rounding errors. The number
   of Ritz values inside must be the one that inertia counts there, or an error is raised.

`Whitening.identity_error` is measured on the whitened rows themselves, in another pass.

Rows whose vector is null or holds a null or non-finite entry are left out, and so are those with an entry too large for a
long (2^42 or more before scaling) and those of another length than most rows have (ties: the shorter). Null and repeated ids
are rows like others; other columns do not matter. No rows left: an empty result. A component without variance (rank below
the number wanted, equal rows, a single row) has explained 0, or null where nothing varies, and whitened null; identity_error regards
the other components and is null if there are none. A deviation beyond a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import arrow_schema, columns_of

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: points of the quadrature on the upper half of a circle
POINTS = 16
_EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list, eigenvalues in falling order and unit eigenvectors (rows), trace and the error measured."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None


def whole_numbers(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x (array<bigint>) of the rows whose vector can be used, of whatever length."""
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(2.0**42), F.lit(False)))  # NaN is larger than any number
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return df.where(good).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def _blocks(batches, d: int, column: int):
    """Batches in parts of about a million numbers, each with its matrix of rows x d."""
    step = max(1, (1 << 20) // d)
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield part, np.asarray(part.column(column).flatten()).reshape(-1, d)


def _summed(rows: DataFrame, d: int, size: int, kind: str, of) -> np.ndarray:
    """Sum over all rows of what `of` makes of a matrix of rows: `size` numbers, one partial sum a task."""
    schema = f"place int, part {kind}"
    arrow = arrow_schema(schema)

    def task(batches):
        total = None
        for _, x in _blocks(batches, d, 0):
            part = of(x)
            total = part if total is None else total + part
        if total is not None:
            yield columns_of(arrow, {"place": np.arange(size, dtype=np.int32), "part": total})

    out = np.zeros(size, np.int64 if kind == "long" else float)
    for place, part in rows.select("x").mapInArrow(task, schema).groupBy("place").agg(F.sum("part")).collect():  # `size` rows
        out[place] = part
    return out


def above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of the symmetric matrix `v` that are larger than `shift`, which should be none of them."""
    a = v - shift * np.eye(len(v))
    count = 0
    while len(a):
        i = int(np.abs(np.diag(a)).argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        p, q = np.unravel_index(int(off.argmax()), off.shape)
        if abs(a[i, i]) >= 0.6403882 * off[p, q]:  # (1 + sqrt(17)) / 8 bounds the growth
            if a[i, i] == 0:
                return count  # all that is left is zero
            order = np.r_[i, np.delete(np.arange(len(a)), i)]
            a = a[np.ix_(order, order)]
            count += a[0, 0] > 0
            a = a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:]) / a[0, 0]
        else:
            order = np.r_[p, q, np.delete(np.arange(len(a)), [p, q])]
            a = a[np.ix_(order, order)]
            count += 1  # such a block has one eigenvalue of either sign
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
        a = (a + a.T) / 2
    return count


def _clear(v: np.ndarray, place: float, least: float) -> float:
    """A place at or a little below `place` with no eigenvalue beside it, as far as such a gap can be found."""
    for width in (1e-3, 1e-5, 1e-8):
        at = place
        while at > max(least, 0.8 * place):
            if above(v, at * (1 + width)) == above(v, at * (1 - width)):
                return at
            at *= 1 - 3 * width if width == 1e-3 else 1 - 1e-3
    return place


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top down, with the `k` largest eigenvalues inside, or all that are not rounding errors."""
    high = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)
    floor = 8 * len(v) * _EPS * high
    k = min(k, above(v, floor))
    if not k:
        return []
    low, top = floor, high
    while top - low > 1e-6 * top:  # the k-th eigenvalue
        middle = np.sqrt(low * top) if low * 2 < top else (low + top) / 2
        low, top = (middle, top) if above(v, middle) >= k else (low, middle)
    low = max(floor, _clear(v, low * (1 - 2e-6), floor))
    out, seen = [], 0
    while high > low:
        cut = low if high / 4 <= low else _clear(v, high / 4, low)
        count = above(v, cut)
        if count > seen:
            out.append((cut, high, count - seen))
        high, seen = cut, count
    return out


def feast(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenvalues of `v` between `low` and `high`, falling, and their unit vectors as rows."""
    d, norm = len(v), float(np.abs(v).sum(axis=1).max())
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(0.5j * np.pi * (nodes + 1))
    centre, radius = (low + high) / 2, (high - low) / 2
    basis = np.random.default_rng(13).standard_normal((d, min(d, 2 * count + 8)))
    before = np.inf
    for _ in range(60):
        filtered = np.zeros_like(basis)
        for t, w in zip(turn, weights, strict=True):
            filtered += (0.5 * w * radius * t * np.linalg.solve((centre + radius * t) * np.eye(d) - v, basis.astype(complex))).real
        q, _ = np.linalg.qr(filtered)
        values, inner = np.linalg.eigh(q.T @ v @ q)
        basis = q @ inner
        inside = np.flatnonzero((values > low) & (values < high))
        rest = np.linalg.norm(v @ basis[:, inside] - basis[:, inside] * values[inside], axis=0).max(initial=0.0)
        if len(inside) == count and (rest <= 2 * _EPS * norm or (rest <= 1e-12 * norm and rest > before / 2)):
            return values[inside][::-1], basis[:, inside[::-1]].T
        before = rest
    raise ArithmeticError(f"{len(inside)} eigenvalues found where inertia counts {count} (residual {rest:g})")


def eigenpairs(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The `k` largest eigenvalues of a covariance and their unit vectors as rows; fewer where the rest are rounding errors."""
    found = [feast(v, *i) for i in intervals(v, k)]
    if not found:
        return np.zeros(0), np.zeros((0, len(v)))
    return np.concatenate([e for e, _ in found])[:k], np.concatenate([u for _, u in found])[:k]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening that rows (vec_id, x) of one length define; None without rows."""
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths or not lengths[0]["d"]:
        return None
    d, n = lengths[0]["d"], lengths[0]["n"]
    rows = rows.where(F.size("x") == d)
    sums = _summed(rows, d, d, "long", lambda x: x.sum(axis=0))
    centred = lambda x: (n * x - sums) / n  # noqa: E731  exact but for the division

    def gram(x):
        c = centred(x)
        return (c.T @ c).ravel()

    v = _summed(rows, d, d * d, "double", gram).reshape(d, d) / n
    v = (v + v.T) / 2
    values, vectors = eigenpairs(v, min(components, d))
    k, error = len(values), None
    if k:
        scaled = vectors.T / np.sqrt(values)

        def white(x):
            w = centred(x) @ scaled
            return np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))

        found = _summed(rows, d, k + k * k, "double", white) / n
        error = float(np.abs(found[k:].reshape(k, k) - np.outer(found[:k], found[:k]) - np.eye(k)).max())
    return Whitening(n, sums, values, vectors, float(np.trace(v)), error)


def transform(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row of `rows` (vec_id, x) and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    arrow = arrow_schema(schema)
    n, sums, d = model.n, model.sums, len(model.sums)
    k, wanted = len(model.values), min(components, d)
    scaled = model.vectors.T / np.sqrt(model.values)
    explained = [float(e / model.trace) for e in model.values] + [0.0 if model.trace > 0 else None] * (wanted - k)

    def task(batches):
        import pyarrow as pa

        for part, x in _blocks(batches, d, 1):
            apart = n * x - sums
            squares = (apart * apart).sum(axis=1)  # right modulo 2^64
            size = np.square(apart.astype(float)).sum(axis=1)
            deviation = squares.tolist()
            for i in np.flatnonzero(size > 2.0**62).tolist():
                exact = sum(a * a for a in apart[i].tolist())
                deviation[i] = exact if exact < 1 << 63 else None
            white = np.full((len(x), wanted), np.nan)
            white[:, :k] = (apart / n) @ scaled
            row = np.repeat(np.arange(len(x)), wanted)
            yield columns_of(arrow, {
                "vec_id": part.column(0).take(pa.array(row)), "component": np.tile(np.arange(1, wanted + 1, dtype=np.int32), len(x)), "n": np.full(len(row), n), "deviation": pa.array(deviation, pa.int64()).take(pa.array(row)),
                "whitened": pa.array(white.ravel(), from_pandas=True), "explained": explained * len(x), "identity_error": [model.identity_error] * len(row),
            })

    return rows.where(F.size("x") == d).select("vec_id", "x").mapInArrow(task, schema)


def whiten(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """`transform` of all rows that can be used, by the whitening that they define."""
    rows = whole_numbers(df, id_col=id_col, vector_col=vector_col)
    model = fit(rows, components)
    if model is None:
        model = Whitening(0, np.zeros(1, np.int64), np.zeros(0), np.zeros((0, 1)), 0.0)
        rows = rows.limit(0)
    return transform(rows, model, components)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """Eight whitened components of every embedding."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
