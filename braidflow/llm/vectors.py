"""Integer vectors: columns as matrices, and products of integers that floats keep exact.

Digit slices: an integer matrix is split into limbs of LIMB_BITS bits, in balanced digits,
so that a float64 product of two limb matrices of up to CHUNK rows adds integers below
2^53 only and is exact, in whatever order BLAS adds. The products are put together again as
integers of any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limbs have values within ±2^20, so that products of CHUNK rows sum up to 2^52 at most.
LIMB_BITS = 21
CHUNK = 4096
#: Integers beyond this are an error: doubles no longer tell them apart.
MOST = 1 << 52


def usable(vector: str) -> Column:
    """Whether a vector is there and all of its components are, and are finite."""
    inf = F.lit(float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: F.coalesce((F.abs(c.cast("double")) < inf) & ~F.isnan(c.cast("double")), F.lit(False)))


def scaled(vector: str, scale: int, shift: int = 0) -> Column:
    """array<long> of floor(scale * c) + shift, with c as double; beyond ±2^60 (which callers
    refuse) the product is held there, so that nothing overflows."""
    held = lambda v: F.greatest(F.least(v, F.lit(2.0**60)), F.lit(-(2.0**60)))
    return F.transform(vector, lambda c: F.floor(held(F.lit(float(scale)) * c.cast("double"))) + F.lit(shift).cast("long"))


def matrix(column: pa.Array, dim: int, fill: int = 0) -> np.ndarray:
    """The rows of a list<long> column as an int64 matrix; shorter ones end in ``fill``."""
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    if (lengths == dim).all():
        return flat.reshape(len(column), dim).astype(np.int64, copy=False)
    out = np.full((len(column), dim), fill, np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


def limb_count(most: int) -> int:
    """Limbs that integers within ±most need."""
    return int(most).bit_length() // LIMB_BITS + 1


def limbs(x: np.ndarray, count: int) -> list[np.ndarray]:
    """Balanced digits of int64 entries, the least first, as float64."""
    half, out = 1 << (LIMB_BITS - 1), []
    for _ in range(count - 1):
        digit = ((x + half) & ((1 << LIMB_BITS) - 1)) - half
        out.append(digit.astype(np.float64))
        x = (x - digit) >> LIMB_BITS
    return [*out, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """a @ b.T of int64 matrices within ±most, as int64; an error where it doesn't fit.

    Columns are taken CHUNK at a time, as they are what a product adds up.
    """
    count, total = limb_count(most), np.zeros((len(a), len(b)), object)
    for at in range(0, a.shape[1], CHUNK):
        left, right = limbs(a[:, at : at + CHUNK], count), limbs(b[:, at : at + CHUNK], count)
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                total += (x @ y.T).astype(np.int64).astype(object) << (LIMB_BITS * (i + j))
    if total.size and max(abs(total.min()), abs(total.max())) >= 1 << 63:
        raise OverflowError("an inner product doesn't fit 64 bits")
    return total.astype(np.int64)


class Gram:
    """Sums of the products of all pairs of columns of int64 rows, exact at any number of
    rows: per power of the limb base, in a low and a high part of int64."""

    LOW = 30

    def __init__(self, dim: int, most: int) -> None:
        self.count = limb_count(most)
        self.upper = np.triu_indices(dim)
        self.low = np.zeros((2 * self.count - 1, len(self.upper[0])), np.int64)
        self.high = np.zeros_like(self.low)

    def add(self, y: np.ndarray) -> None:
        for at in range(0, len(y), CHUNK):
            part = limbs(y[at : at + CHUNK], self.count)
            for i, a in enumerate(part):
                for j, b in enumerate(part):
                    product = (a.T @ b)[self.upper].astype(np.int64)
                    self.low[i + j] += product & ((1 << self.LOW) - 1)
                    self.high[i + j] += product >> self.LOW

    @staticmethod
    def whole(power: int, low: int, high: int) -> int:
        return (low + (high << Gram.LOW)) << (LIMB_BITS * power)
