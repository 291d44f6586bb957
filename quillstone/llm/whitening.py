"""Whitening of embeddings: principal components from a randomised range finder, over exact integer vectors.

An entry c becomes the whole number floor(SCALE * c) + OFFSET. The fit list holds each distinct vector once; its sums are
exact, and every product is taken of centred rows. A random basis of `k + OVERSAMPLING` columns goes through repeated power
passes: in each one, tasks multiply their rows with the basis, and the partial products are added up row by row of the
covariance. Rayleigh-Ritz on the basis gives components, whose residuals say whether they are right to double precision.
Where they are not, and the rate at which they shrink does not promise it within `MOST_PASSES`, the basis is expanded to the
full dimension, for which one pass is exact; where spectra are flat, that is the rule.

The driver holds one basis: dimension times columns. Each task holds a batch of rows and one partial product, which leaves it
in rows of the matrix. Rows are read, never gathered; the fit list is one stored table.

Defined cases: vectors that are null or hold null or non-finite entries are dropped, as are those whose length is not the most
common one (of equally common ones the longer); entries beyond +-2^40 after scaling are taken as that bound. Repeated rows
are one entry of the fit list and a row each of the result. A component needs a variance that stands out from rounding, so
there are fewer than k where the rank is less, and none for one distinct vector or an empty table: the result is then empty.
A deviation that no long holds is null. Other columns pass through `transform`; a kept column of an added name gives way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from quillstone.llm.common import bound_batches, col, drop_table, map_column, shared_table

SCALE, OFFSET = 64, 1_000_000
LIMIT = 1 << 40
COMPONENTS = 16
OVERSAMPLING = 16
MOST_PASSES = 8
#: Largest residual of a component, as a share of the largest variance, at which it counts as exact.
RESIDUAL = 1e-13
#: A component whose share of the largest variance is below this is rounding.
RANK = 1e-12
SEED = 11


def whole_numbers(vector: Column) -> Column:
    """The entries as longs."""
    scaled = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))
    return F.transform(vector, lambda c: F.floor(scaled(c)).cast("long") + OFFSET)


def usable(vector: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)


@dataclass(frozen=True)
class Whitening:
    """What `transform` needs; `sums` are exact, and a row of `components` is a unit eigenvector."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float
    #: Power passes, and whether the basis had to be expanded.
    passes: int
    expanded: bool

    def centred(self, x: np.ndarray) -> np.ndarray:
        return gaps(x, self.n, self.sums).astype(np.float64) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.variances)


def gaps(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as longs, or as Python's integers where a long could overflow."""
    most = n * (int(np.abs(x).max()) if x.size else 0) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum of the squared gaps of each row, exactly; null beyond a long."""
    g = gaps(x, n, sums)
    if g.dtype != object and (not g.size or x.shape[1] * int(np.abs(g).max()) ** 2 < 1 << 63):
        return pa.array((g * g).sum(1), pa.int64())
    squares = (g.astype(object) ** 2).sum(1)
    return pa.array([int(s) if s < 1 << 63 else None for s in squares], pa.int64())


def added_up(fit: DataFrame, dim: int, width: int, product: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of a product that has `width` columns: partial sums of tasks, added up row by row of the matrix."""
    schema = StructType([StructField("i", IntegerType()), StructField("part", BinaryType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                p = product(matrix(b.column(0), dim))
                total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], schema.names)

    def whole(parts: pa.Table) -> pa.Table:
        # one row for each task
        total = np.zeros(width)
        for p in parts.column(1).to_pylist():
            total += np.frombuffer(p, np.float64)
        return pa.table([parts.column(0).slice(0, 1), pa.array([total.tobytes()], pa.binary())], schema.names)

    parts = fit.select("x").mapInArrow(partial, schema)
    rows = parts.groupBy("i").applyInArrow(whole, schema).collect()  # as many rows as the matrix has
    out = np.zeros((max((r["i"] for r in rows), default=-1) + 1, width))
    for r in rows:
        out[r["i"]] = np.frombuffer(bytes(r["part"]), np.float64)
    return out


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows, and the sum of each dimension; a task's sums leave it as decimals of the longest kind."""
    spread = fit.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n"))
    rows = {r["d"]: r for r in spread.collect()}  # one for each dimension
    return (int(rows[0]["n"]) if rows else 0), [int(rows[d]["s"]) for d in range(dim)] if rows else [0] * dim


def common_length(vectors: DataFrame, vector: str) -> int:
    """The most common length of usable vectors, the longer of two; 0 if there are none."""
    sizes = vectors.where(usable(col(vector))).groupBy(F.size(col(vector)).alias("d")).count()
    found = sizes.agg(F.max_by("d", F.struct("count", "d")).alias("d")).first()["d"]
    return int(found or 0)


def fit(vectors: DataFrame, vector: str, k: int = COMPONENTS) -> Whitening | None:
    """Learn from the distinct vectors; None where there is nothing to whiten."""
    bound_batches(vectors.sparkSession)
    dim = common_length(vectors, vector)
    if not dim:
        return None
    sound = vectors.where(usable(col(vector)) & (F.size(col(vector)) == dim))
    distinct = shared_table(sound.select(whole_numbers(col(vector)).alias("x")).distinct(), "fit")
    n, sums = exact_sums(distinct, dim)
    centred = lambda x: gaps(x, n, sums).astype(np.float64) / n

    def times(basis: np.ndarray | None) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c if basis is None else c @ basis)

        return added_up(distinct, dim, dim if basis is None else basis.shape[1], product) / n

    trace = float(added_up(distinct, dim, dim, lambda x: (centred(x) ** 2).sum(0)[None]).sum()) / n
    if not trace > 0:
        drop_table(distinct)
        return None
    variances, components, passes, expanded = ritz(times, dim, k)
    solid = variances > RANK * variances[0]
    variances, components = variances[solid], components[solid]

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ components.T / np.sqrt(variances)
        return np.vstack([w.T @ w, w.sum(0)])

    held = added_up(distinct, dim, len(variances), moments) / n
    error = held[:-1] - np.outer(held[-1], held[-1]) - np.eye(len(variances))
    drop_table(distinct)
    return Whitening(n, sums, components, variances, variances / trace, float(np.abs(error).max()), passes, expanded)


def ritz(times: Callable[[np.ndarray | None], np.ndarray], dim: int, k: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """The k largest variances and their components (as rows), the passes, and whether the whole dimension was needed."""
    rng, columns = np.random.default_rng(SEED), min(dim, k + OVERSAMPLING)
    basis = np.linalg.qr(rng.standard_normal((dim, columns)))[0]
    passes, before, expanded = 0, None, columns == dim
    while True:
        # for the whole space the product is the covariance, and its own components are exact
        whole = columns == dim
        image = times(None if whole else basis)
        passes += 1
        small = image if whole else basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(-values, kind="stable")[: min(k, columns)]
        values, turn = np.maximum(values[top], 0), turn[:, top]
        if whole:
            return values, turn.T, passes, expanded
        found = basis @ turn
        worst = float(np.linalg.norm(image @ turn - found * values, axis=0).max()) / max(values[0], 1e-300)
        if worst <= RESIDUAL:
            return values, found.T, passes, False
        left, rate = MOST_PASSES - passes, worst / before if before else 1.0
        if left <= 0 or (before and worst * rate**left > RESIDUAL):
            columns, expanded = dim, True
            continue
        before, basis = worst, np.linalg.qr(image)[0]


def transform(vectors: DataFrame, vector: str, keep: list[str], model: Whitening | None) -> DataFrame:
    """`keep`, deviation and whitened (an array) of the rows that take part."""
    added = [StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))]
    dim = len(model.sums) if model else -1
    sound = vectors.where(usable(col(vector)) & (F.size(col(vector)) == dim))

    def make(column: pa.Array) -> list[pa.Array]:
        if model is None:
            return [pa.array([], pa.int64()), pa.array([], pa.list_(pa.float64()))]
        x = matrix(column, dim)
        w = model.whitened(x)
        ends = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
        return [deviations(x, model.n, model.sums), pa.ListArray.from_arrays(ends, pa.array(w.ravel(), pa.float64()))]

    return map_column(sound, keep, whole_numbers(col(vector)), added, make)


def components_of(vectors: DataFrame, id_column: str, vector: str, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    model = fit(vectors, vector, k)
    rows = transform(vectors.select(col(id_column).alias("vec_id"), col(vector).alias("v")), "v", ["vec_id"], model)
    rows = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("p", "whitened"))
    explained = F.array(*(F.lit(float(e)) for e in model.explained)) if model else F.array().cast("array<double>")
    return rows.select(
        "vec_id", (F.col("p") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("p")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
