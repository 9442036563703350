"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X stay distributed. Step j multiplies them twice: X v gives the next left
vector, one number a row, and X'u the next right one; both are reorthogonalised against all
earlier ones. A left vector is as long as the table, so it is never stored: it lies in the
range of X, u = X y, and a task makes its entries anew from its rows and the short y. Only sums
over rows, as long as a vector has dimensions, come to the driver. The singular values of the
small bidiagonal matrix give deviations, its right vectors the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.session import materialize

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Singular values below this share of the largest are rounding, not directions of the data.
FLAT = 1e-10
_SEED = 5
_LONG = (1 << 63) - 1


def quantised(entry: Column) -> Column:
    """An entry as the whole number floor(64 * c) + 1,000,000."""
    return F.floor(F.lit(SCALE) * entry.cast("double")).cast("long") + F.lit(SHIFT)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


@dataclass(frozen=True)
class Whitening:
    """Row count, sums per dimension, components (one a row) by falling variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float


def _sums(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], n: int, sums: np.ndarray) -> np.ndarray:
    """The sum over all batches of part(centred rows), a vector of bounded length.

    A task adds up its batches and sends one vector; vectors are added place by place.
    """
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in source:
            if batch.num_rows:
                own = part(_centred(batch.column("x"), n, sums))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "v"])

    added = rows.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(added))
    for r in added:
        out[r["at"]] = r["v"]
    return out


def _whole(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _centred(col: pa.Array, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n as one rounding of the exact quotient (n*x - S) / n."""
    return (n * _whole(col, len(sums)) - sums).astype(np.float64) / n


def bidiagonalise(rows: DataFrame, n: int, sums: np.ndarray, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors V (dimensions x steps) and upper bidiagonal B with X V = U B, U'U = 1.

    Each step has two passes over the rows: the first gives X v and what it has in common with
    the earlier left vectors, the second X'u and what is left in common after that. Where a
    right vector vanishes (the rows span no more, or deviations are equal), a new direction at
    right angles to all before goes on, so that all dimensions are reached.
    """
    dims = len(sums)
    steps = min(steps or dims, dims)
    rng = np.random.default_rng(_SEED)
    right, left, images = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((dims, 0))
    b = np.zeros((steps, steps))
    v, top = _unit_beside(rng, right), 0.0
    for j in range(steps):
        def forward(x, v=v, left=left):
            w = x @ v
            return np.concatenate([(x @ left).T @ w, [w @ w]])

        got = _sums(rows, forward, n, sums)
        common, square = got[:-1], got[-1]
        norm = np.sqrt(max(square, 0.0))
        top = max(top, norm)
        alpha = np.sqrt(max(square - common @ common, 0.0))
        right = np.column_stack([right, v])
        y, z, size = np.zeros(dims), np.zeros(dims), 0.0
        if alpha > FLAT * top:
            def back(x, y=(v - left @ common) / alpha, left=left):
                u = x @ y
                return np.concatenate([x.T @ u, (x @ left).T @ u, [u @ u]])

            got = _sums(rows, back, n, sums)
            rest, size = got[dims:-1], np.sqrt(max(got[-1] - got[dims:-1] @ got[dims:-1], 0.0))
            if alpha * size > FLAT * top:
                y, z = ((v - left @ common) / alpha - left @ rest) / size, (got[:dims] - images @ rest) / size
                common = common + alpha * rest
        # else v adds nothing: the rows do not vary along it beyond what is known
        alpha = alpha * size if alpha * size > FLAT * top else 0.0
        b[j, j] = alpha
        if j:
            b[j - 1, j] = common[j - 1]
        left, images = np.column_stack([left, y]), np.column_stack([images, z])
        if j + 1 == steps:
            break
        r = z - alpha * v
        for _ in range(2):
            r = r - right @ (right.T @ r)
        beta = np.linalg.norm(r)
        v = r / beta if beta > FLAT * top else _unit_beside(rng, right)
    return right, b


def _unit_beside(rng: np.random.Generator, known: np.ndarray) -> np.ndarray:
    """A direction at right angles to the known ones."""
    r = rng.standard_normal(len(known))
    for _ in range(3):
        r = r - known @ (known.T @ r)
        r = r / np.linalg.norm(r)
    return r


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The usable rows of the most common length as (id, x): whole numbers, written once, since every pass reads them."""
    slim = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("v")).where(usable(F.col("v")))
    common = slim.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    whole = slim.where(F.size("v") == (common["d"] if common else 0))
    return materialize(whole.select("id", F.transform("v", quantised).alias("x")), "whitening")


def fit(rows: DataFrame, components: int = COMPONENTS, steps: int | None = None) -> Whitening | None:
    """The whitening of prepared rows; None without rows. `steps` below the number of
    dimensions ends the bidiagonalisation early (components are then approximate)."""
    head = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    n, dims = head["n"], head["dims"]
    if not n:
        return None
    totals = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("s")).collect()
    sums = np.zeros(dims, np.int64)
    for r in totals:
        sums[r["at"]] = r["s"]
    right, b = bidiagonalise(rows, n, sums, steps)
    _, sigma, turned = np.linalg.svd(b)
    keep = [i for i in range(min(components, len(sigma))) if sigma[0] > 0 and sigma[i] > FLAT * sigma[0]]
    axes = (right @ turned.T).T[keep]
    trace = _sums(rows, lambda x: np.array([(x * x).sum()]), n, sums)[0] / n
    return Whitening(n, sums, axes / np.linalg.norm(axes, axis=1, keepdims=True), sigma[keep] ** 2 / n, trace)


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, values): each prepared row along all components, over their deviations."""
    n, sums, dims = model.n, model.sums, len(model.sums)
    turn = (model.components / np.sqrt(model.variances)[:, None]).T
    def deviations(x: np.ndarray) -> pa.Array:
        off = n * x - sums
        if len(off) and float(np.abs(off).max()) ** 2 * dims < 2.0 ** 62:
            return pa.array((off * off).sum(1))
        exact = [sum(int(c) ** 2 for c in row) for row in off]
        return pa.array([e if e <= _LONG else None for e in exact], pa.int64())

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            got = _centred(batch.column("x"), n, sums) @ turn
            ends = np.arange(0, got.size + 1, max(got.shape[1], 1), dtype=np.int32) if got.shape[1] else np.zeros(len(got) + 1, np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(got.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), deviations(_whole(batch.column("x"), dims)), values], ["id", "deviation", "values"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(run, f"id {kind}, deviation long, values array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened rows is from the identity, at its worst entry."""
    k = len(model.components)
    if not k:
        return 0.0
    turn = (model.components / np.sqrt(model.variances)[:, None]).T

    def part(x: np.ndarray) -> np.ndarray:
        w = x @ turn
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    got = _sums(rows, part, model.n, model.sums) / model.n
    mean = got[k * k:]
    return float(np.abs(got[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def digest(vectors: DataFrame, components: int = COMPONENTS, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    A vector that is null, empty, holds null or non-finite entries, or has another length than
    the most common one has no row. Repeated rows count as often as they stand there; ids may be
    null or repeat; other columns are ignored. A direction without variance is no component, so equal vectors, a single one, or an empty
    table give no rows. `deviation` is null where the exact sum does not fit a long.
    """
    spark = vectors.sparkSession
    rows = prepared(vectors, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    model = fit(rows, components)
    if model is None:
        return spark.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.variances]) if len(model.variances) else F.array().cast("array<double>")
    error = identity_error(rows, model)
    out = whitened(rows, model).select("id", "deviation", F.posexplode("values").alias("k", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
