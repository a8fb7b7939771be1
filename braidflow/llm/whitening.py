"""Whitening of embeddings from an exact covariance, by digit-slice matrix products.

Components become integers, floor(1024 c) + 100000. A first pass gives their number and
sums. The second takes the integers nearest the means away and sums the products of what is
left: each batch is split into limbs so small that float64 products are exact, the limbs'
sums are added by Spark and put together as integers of any size. What rounding the means
left is taken out exactly as well, so the covariance is the true one, rounded once; then it
is eigendecomposed on the driver, which holds numbers in proportion to the dimension's
square and to nothing else.

What input gives: rows whose vector is null, or holds null, NaN or infinite entries, go; a
null vec_id stays; repeated rows count each; other columns, of whatever name, are ignored; a
table without usable rows gives none. Vectors shorter than the longest count as ending in
zeros. Components that have no variance (to double precision: below 10^-12 of the first)
have null as ``whitened`` and aren't part of ``identity_error``. ``deviation`` is null where
it doesn't fit a long. Entries of 2^30 or more are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

SCALE, SHIFT = 1024, 100_000
MOST_ENTRY = 1 << 30
#: Eigenvalues below this part of the largest are none.
LEAST_VARIANCE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n vectors with integer sums per dimension; the first components and eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    trace: float
    most: int  # largest entry's size

    @property
    def dim(self) -> int:
        return len(self.sums)


def integers(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The usable rows, with ``x``: their entries as integers."""
    return df.where(vectors.usable(vector)).withColumn("x", vectors.scaled(vector, SCALE, SHIFT))


def totals(x: DataFrame) -> tuple[int, list[int], int]:
    """Rows, sums of each dimension and the largest entry's size; one JVM aggregation."""
    # An entry of 1 before the others counts the rows.
    entries = x.select(F.posexplode(F.concat(F.array(F.lit(1).cast("long")), F.col("x"))).alias("i", "v"))
    found = entries.groupBy("i").agg(F.sum(F.col("v") - SHIFT).alias("s"), F.count("*").alias("n"), F.max(F.abs(F.col("v"))).alias("most")).orderBy("i").collect()
    if not found:
        return 0, [], 0
    n = found[0]["n"]
    most = max((r["most"] for r in found[1:]), default=0)
    if most >= SCALE * MOST_ENTRY:
        raise ValueError(f"an entry is {MOST_ENTRY} or more")
    return n, [r["s"] + n * SHIFT for r in found[1:]], max(most, SHIFT)


def covariance(x: DataFrame, n: int, sums: list[int], most: int) -> np.ndarray:
    """The covariance (divisor n) of the rows' integers, each entry rounded once."""
    dim = len(sums)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    bound = most + int(np.abs(centre).max(initial=0))
    common.ship(x.sparkSession)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = vectors.Gram(dim, bound)
        for batch in common.bounded(batches):
            gram.add(vectors.matrix(batch.column(0), dim, SHIFT) - centre)
        powers = np.arange(len(gram.low), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(powers), pa.array(list(gram.low), pa.list_(pa.int64())), pa.array(list(gram.high), pa.list_(pa.int64()))], ["power", "low", "high"])

    parts = x.select("x").mapInArrow(products, "power int, low array<long>, high array<long>")
    cells = parts.select("power", F.posexplode(F.arrays_zip("low", "high")).alias("cell", "v")).groupBy("power", "cell").agg(F.sum("v.low").alias("low"), F.sum("v.high").alias("high"))
    rows, cols = np.triu_indices(dim)
    total = [0] * len(rows)
    for r in cells.toLocalIterator():
        total[r["cell"]] += vectors.Gram.whole(r["power"], r["low"], r["high"])
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    out = np.zeros((dim, dim))
    for k, (i, j) in enumerate(zip(rows.tolist(), cols.tolist())):
        out[i, j] = out[j, i] = (n * total[k] - rest[i] * rest[j]) / (n * n)  # of integers: rounded once
    return out


def fit(x: DataFrame, components: int = 8) -> Whitening | None:
    """From all rows of ``integers``; None if there are none."""
    n, sums, most = totals(x)
    if not n or not sums:
        return None
    v = covariance(x, n, sums, most)
    values, found = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    found = found[:, order]
    sign = np.sign(found[np.abs(found).argmax(axis=0), np.arange(len(order))])  # the largest entry is positive
    return Whitening(n, sums, found * np.where(sign == 0, 1, sign), values[order], float(np.trace(v)), most)


def transform(x: DataFrame, model: Whitening, vec_id: str = "vec_id") -> DataFrame:
    """vec_id, ``deviation`` and ``z``, the whitened coordinates, of every row."""
    n, dim = model.n, model.dim
    sums = np.array(model.sums, object)
    kept = (model.eigenvalues > 0) & (model.eigenvalues > LEAST_VARIANCE * model.eigenvalues.max(initial=0))
    scale = np.where(kept, 1 / np.sqrt(np.where(kept, model.eigenvalues, 1)), np.nan)
    map_ = model.components * scale
    largest = n * model.most + max(map(abs, model.sums))
    common.ship(x.sparkSession)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            y = vectors.matrix(batch.column(1), dim, SHIFT)
            if largest < 1 << 62:
                y = n * y - sums.astype(np.int64)
                # Of as many int64 squares as there are dimensions, or else of integers of any size.
                few = int(np.abs(y).max(initial=0)) ** 2 * dim < 1 << 63
                deviation = (y * y).sum(axis=1).tolist() if few else (y.astype(object) ** 2).sum(axis=1).tolist()
            else:
                y = n * y.astype(object) - sums
                deviation = (y * y).sum(axis=1).tolist()
            z = (y.astype(np.float64) / n) @ map_
            columns = [batch.column(0), pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "z"])

    return x.select(F.col(vec_id).cast("long").alias("vec_id"), "x").mapInArrow(project, "vec_id long, deviation long, z array<double>")


def identity_error(z: DataFrame, components: int) -> float:
    """The largest entry of the whitened rows' covariance less the identity's, of components
    that have variance."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = z.agg(*(F.covar_pop(F.get("z", F.lit(i)), F.get("z", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max((abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs if not np.isnan(found[f"c{i}_{j}"])), default=0.0)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = 8, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """A row per usable row and component, as RESULT says; fitted on all usable rows.

    Four scans at most: sums, products, projection (written, so that what follows reads
    the few coordinates), and the check of the whitened rows.
    """
    spark = df.sparkSession
    x = integers(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding")))
    model = fit(x, components)
    if model is None:
        return spark.createDataFrame([], RESULT)
    z = common.written(transform(x, model), "whitened")
    error = identity_error(z, len(model.eigenvalues))
    explained = F.array(*(F.lit(float(e / model.trace) if model.trace else 0.0) for e in model.eigenvalues))
    rows = z.select("vec_id", "deviation", F.posexplode("z").alias("i", "w"))
    return rows.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.nanvl("w", F.lit(None).cast("double")).alias("whitened"), F.get(explained, "i").alias("explained"), F.lit(error).alias("identity_error"),
    )
