"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Vectors become whole numbers, so counts, sums and the scatter around whole centres are exact whatever the order in
which tasks add them. Only matrices of the size of the vector's dimension reach the driver.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch

SCALE, OFFSET = 64, 1_000_000
# An eigenvalue below this share of the largest is rounding, not spread.
TINY = 1e-12


@dataclass(frozen=True)
class Whitener:
    """What a fit holds: rows and sums of the fit list, unit components in rows, their eigenvalues, and the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return self.n * x - self.sums

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x).astype(float) @ self.components.T) / (self.n * np.sqrt(self.values))


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Columns l with a = l l', taken by the largest diagonal left, until nothing but rounding is left."""
    rest, cols = a.astype(float).copy(), []
    first = rest.diagonal().max(initial=0.0)
    while len(cols) < len(a):
        p = int(np.argmax(rest.diagonal()))
        if rest[p, p] <= first * 1e-15:
            break
        col = rest[:, p] / np.sqrt(rest[p, p])
        cols.append(col)
        rest -= np.outer(col, col)
        rest[p, :] = rest[:, p] = 0.0  # done with
    return np.stack(cols, axis=1) if cols else np.zeros((len(a), 0))


def one_sided_jacobi(m: np.ndarray, most: int = 60) -> np.ndarray:
    """``m`` times a rotation, with orthogonal columns. Each step turns half of all columns with the other half."""
    m = m.copy()
    k = m.shape[1]
    if k < 2:
        return m
    order = np.arange(k + k % 2)  # one empty place makes an odd number even
    eps = np.finfo(float).eps
    for _ in range(most):
        turned = False
        for _ in range(len(order) - 1):
            p, q = order[: len(order) // 2], order[len(order) // 2 :][::-1]
            here = (p < k) & (q < k)
            p, q = p[here], q[here]
            x, y = m[:, p], m[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            act = np.abs(c) > eps * np.sqrt(a * b)
            if act.any():
                turned = True
                with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
                    zeta = (b - a) / (2 * c)
                    t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                t = np.where(act, t, 0.0)
                cos = 1 / np.sqrt(1 + t * t)
                m[:, p], m[:, q] = cos * (x - t * y), cos * (t * x + y)
            order = np.concatenate((order[:1], order[-1:], order[1:-1]))
        if not turned:
            break
    return m


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in rows, of a positive semi-definite matrix; none for rounding."""
    turned = one_sided_jacobi(pivoted_cholesky(covariance))
    values = (turned * turned).sum(0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > TINY * values.max(initial=0.0)] if len(order) else order
    return values[order], (turned[:, order] / np.sqrt(values[order])).T


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _exact_products(y: np.ndarray) -> np.ndarray:
    """y' y of whole numbers; as floats only while every sum is exact."""
    step = max(1, int(2**52 // max(1.0, float(np.abs(y).max(initial=0)) ** 2)))
    if step < 64:
        return y.T @ y
    return sum((y[i : i + step].astype(float).T @ y[i : i + step].astype(float)).astype(np.int64) for i in range(0, len(y), step))


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``x`` of the rows whose vector is there and has finite entries only; x = floor(64 c) + 1,000,000.

    Vectors must have one length to be whitened together: that of most rows (of equals, the longest). Empty vectors and
    those of another length are left out like those with null or infinite entries.
    """
    vector = F.col(f"`{vector_col}`")
    sound = F.coalesce(F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))), F.lit(False))
    x = F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + OFFSET).cast("long"))
    return df.select(F.col(f"`{id_col}`").alias("id"), F.when(sound, x).alias("x")).where("size(x) > 0")


def _add_up(blocks: DataFrame) -> dict[tuple[int, int], int]:
    """Sums of (i, j, v) over all tasks, one for each place of a matrix."""
    return {(r["i"], r["j"]): int(r["v"]) for r in blocks.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}


def _places(m: np.ndarray) -> pa.RecordBatch:
    i, j = np.indices(m.shape)
    return pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(m.ravel().astype(np.int64))], names=["i", "j", "v"])


PLACES = "i int, j int, v long"


def fit(vectors: DataFrame, dim: int, most: int) -> Whitener | None:
    """Fit over distinct ``x``; None if there are none. Two passes: counts and sums, then products around whole centres."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((1, dim + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), dim)
            out += np.append(x.sum(0), len(x))
        yield _places(out)

    got = _add_up(vectors.mapInArrow(totals, PLACES))
    n = got.get((0, dim), 0)
    if not n:
        return None
    exact = [got[0, j] for j in range(dim)]
    centre = np.array([(2 * s + n) // (2 * n) for s in exact], np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((dim, dim), np.int64)
        for batch in batches:
            out += _exact_products(_matrix(batch.column("x"), dim) - centre)
        yield _places(out)

    scatter = _add_up(vectors.mapInArrow(products, PLACES))
    # The centre is off the mean by less than one half; what that adds is taken off in whole numbers.
    off = [s - n * int(c) for s, c in zip(exact, centre, strict=True)]
    v = np.array([[(n * scatter[i, j] - off[i] * off[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    values, components = eigen(v)
    return Whitener(n, np.array(exact, np.int64), components[:most], values[:most], float(np.trace(v)))


def identity_error(vectors: DataFrame, w: Whitener) -> float:
    """Largest distance of the whitened covariance of the fit list from the identity, measured on the whitened rows."""
    dim, k = len(w.sums), len(w.values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, out, rows = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            y = w.apply(_matrix(batch.column("x"), dim))
            sums, out, rows = sums + y.sum(0), out + y.T @ y, rows + len(y)
        i, j = np.indices((k + 1, k))
        all_ = np.vstack((out, sums))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(all_.ravel())], names=["i", "j", "v"])

    # The mean of the whitened rows is zero up to rounding, so taking it off afterwards loses nothing.
    got = np.zeros((k + 1, k))
    for r in vectors.mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        got[r["i"], r["j"]] = r["v"]
    mean = got[k] / w.n
    return float(np.abs(got[:k] / w.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 16) -> DataFrame:
    """``id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``: a row for each row of
    ``df`` that has a sound vector and each of the first ``most`` components.

    The fit list is each distinct vector once; repeated rows, null ids and ids given twice are rows like others. Components
    without spread are none, so a table of one vector, or an empty one, has no rows; fewer components than ``most`` are
    as many as there are. The fit list is written as a table in the shared folder and read by each pass.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[id_col]
    rows = whole_vectors(df, id_col, vector_col)
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 0
    rows = rows.where(F.size("x") == dim)
    path = os.path.join(scratch(spark, "whitening"), "fit")
    rows.select("x").distinct().write.parquet(path)
    vectors = spark.read.schema("x array<long>").parquet(path)
    w = fit(vectors, dim, most) if dim else None
    error = identity_error(vectors, w) if w else 0.0
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values) if w else 0
        for batch in batches:
            if not k:
                continue
            x = _matrix(batch.column("x"), dim)
            y, apart = w.apply(x), (w.centred(x) ** 2).sum(1)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), w.n, np.int64)),
                pa.array(apart[each]), pa.array(y.ravel()), pa.array(np.tile(w.values / w.trace, len(x))), pa.array(np.full(len(each), error)),
            ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
