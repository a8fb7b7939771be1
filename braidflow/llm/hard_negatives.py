"""Hard negatives of anchors by inner product, over k-means inverted lists with radii.

Rows are dealt to the nearest centroid (of a bounded sample's k-means) and stored as blocks
of one list each, with the list's centroid and the block's radius about it. For an anchor q
no member of a block can score above q·c + |q| r (Cauchy-Schwarz), nor below q·c - |q| r. A
search visits the blocks by falling bound, skips those that lie outside an anchor's score
window, and stops when the bound falls strictly below the kth score, so that ties are still
seen. Scores are exact integers: products run in float32 or float64 where norms show that
every partial sum is exact there, else in digit slices.

Anchors meet the blocks in blocks as well: the lists' blocks are dealt over segments of a
bounded number of rows, whatever list they are of, so that a list with a third of all rows
is as spread as any; each segment sees all anchors in packs, a bounded number at a time.
Segments return their best candidates only. Negatives are searched in two waves: what the
first eighth of the segments finds bounds the kth scores that the others start from.

What input gives: rows with a null id or label, a null vector, or null or non-finite
components take no part; repeated rows are rows each, as candidates and as anchors, and rows
that share an anchor's id are never its positives or negatives; ties go by the smaller id;
vectors shorter than the longest count as ending in zeros; other columns, of whatever name,
are ignored; a table without usable rows gives none. Integers of 2^52 or more, and scores
beyond 64 bits, are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, vectors

#: Rows that the centroids are fitted on at most, and components among them.
SAMPLE_ROWS = 8192
SAMPLE_VALUES = 1 << 21
MOST_LISTS = 256
BLOCK_ROWS = 1024
PACK_ROWS = 256
#: Rows that a segment's task holds, and anchors that one task compares with them, about.
SEGMENT_ROWS = 1 << 18
ANCHOR_ROWS = 1 << 18
#: Up to so many segments, of so many rows, only to have tasks enough.
FEW_SEGMENTS, FEW_ROWS = 8, 8192
#: From so many segments on there are two waves.
WAVES_FROM = 16

_LEAST, _GREATEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Shape:
    """Numbers that decide storage: usable rows, anchors among them, dimension, largest size."""

    rows: int
    anchors: int
    dim: int
    most: int

    @property
    def dtype(self) -> np.dtype:
        """The smallest integers that hold the components."""
        return np.dtype(next(t for t in (np.int16, np.int32, np.int64) if self.most <= np.iinfo(t).max))


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centroids at most, of distinct rows first."""
    x = x.astype(np.float64)
    seeds = np.unique(x, axis=0)
    c = seeds[np.random.default_rng(0).permutation(len(seeds))[:k]]
    for _ in range(rounds):
        own = nearest(x, c)[0]
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance to it."""
    own = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
    return own, np.linalg.norm(x - c[own], axis=1)


# ---------------------------------------------------------------- lists


def _rows(column: pa.Array, dim: int, dtype: np.dtype) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), dim)


def dealt(x: DataFrame, shape: Shape, centroids: np.ndarray) -> DataFrame:
    """id, label, vector (bytes), list, and a salt that bounds the rows of one (list, salt)."""
    dim, dtype = shape.dim, shape.dtype

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(len(centroids), np.int64)
        for batch in common.bounded(batches):
            m = vectors.matrix(batch.column(2), dim)
            own = nearest(m.astype(np.float64), centroids)[0]
            nth = np.empty(len(own), np.int64)
            order = np.argsort(own, kind="stable")
            first = np.searchsorted(own[order], np.arange(len(centroids)))
            nth[order] = np.arange(len(own)) - first[own[order]]
            salt = task // 64 * 65536 + (seen[own] + nth) // BLOCK_ROWS
            seen += np.bincount(own, minlength=len(centroids))
            width = dim * dtype.itemsize
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(m, dtype))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw, pa.array(own, pa.int32()), pa.array(salt, pa.int64())], ["id", "label", "vector", "list", "salt"])

    return x.select("id", "label", "x").mapInArrow(deal, "id long, label long, vector binary, list int, salt long")


def _runs(batches: Iterator[pa.RecordBatch], size: int, by_list: bool, dim: int, dtype: np.dtype) -> Iterator[tuple]:
    """Of rows that come list by list: (list, ids, labels, matrix) of up to ``size`` rows."""
    left = None
    for batch in common.bounded(batches):
        part = (batch.column(3).to_numpy(), batch.column(0).to_numpy(), batch.column(1).to_numpy(), _rows(batch.column(2), dim, dtype))
        left = part if left is None else tuple(np.concatenate(p) for p in zip(left, part))
        at, n = 0, len(left[0])
        while at < n:
            end = at + int(np.searchsorted(left[0][at:], left[0][at], "right")) if by_list else n
            stop = min(end, at + size)
            if stop == n and stop - at < size:
                break  # its next rows may follow
            yield left[0][at], *(p[at:stop] for p in left[1:])
            at = stop
        left = tuple(p[at:] for p in left)
    if left is not None and len(left[0]):
        yield left[0][0], *left[1:]


BLOCKS = "list int, radius double, ids binary, labels binary, vectors binary"
PACKS = "pack long, ids binary, labels binary, vectors binary"


def lists(x: DataFrame, shape: Shape, centroids: np.ndarray) -> DataFrame:
    """Inverted lists as blocks, ids rising within each; written."""
    dim, dtype = shape.dim, shape.dtype

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, ids, labels, m in _runs(batches, BLOCK_ROWS, True, dim, dtype):
            order = np.argsort(ids, kind="stable")
            radius = np.linalg.norm(m - centroids[own], axis=1).max()
            yield pa.RecordBatch.from_pylist([{"list": int(own), "radius": float(radius), "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "vectors": m[order].tobytes()}], pa.schema([("list", pa.int32()), ("radius", pa.float64()), *((k, pa.binary()) for k in ("ids", "labels", "vectors"))]))

    rows = dealt(x, shape, centroids).repartition(F.col("list"), F.col("salt")).sortWithinPartitions("list")
    return common.written(rows.select("id", "label", "vector", "list").mapInArrow(pack, BLOCKS), "lists")


def packs(x: DataFrame, shape: Shape, centroids: np.ndarray) -> DataFrame:
    """The anchors, near ones together, PACK_ROWS a row; written."""
    dim, dtype = shape.dim, shape.dtype

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, (_, ids, labels, m) in enumerate(_runs(batches, PACK_ROWS, False, dim, dtype)):
            yield pa.RecordBatch.from_pylist([{"pack": first + i, "ids": ids.tobytes(), "labels": labels.tobytes(), "vectors": m.tobytes()}], pa.schema([("pack", pa.int64()), *((k, pa.binary()) for k in ("ids", "labels", "vectors"))]))

    parts = -(-shape.anchors // (1 << 16))
    rows = dealt(x.where("anchor"), shape, centroids).repartition(parts, F.col("list"), F.col("salt")).sortWithinPartitions("list", "id")
    return common.written(rows.select("id", "label", "vector", "list").mapInArrow(pack, PACKS), "anchors")


# ---------------------------------------------------------------- search of a segment


class Best:
    """The k best (score, id) of each slot, scores falling, ids rising within a score."""

    def __init__(self, slots: int, k: int, floor: np.ndarray) -> None:
        self.k = k
        self.scores = np.full((slots, k), _LEAST)
        self.ids = np.full((slots, k), _GREATEST)
        self.floor = floor  # what a score must reach anyway

    @property
    def kth(self) -> np.ndarray:
        return np.maximum(self.floor, self.scores[:, -1])

    def add(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        touched, k = np.unique(slot), self.k
        slots = np.concatenate((np.repeat(touched, k), slot))
        scores = np.concatenate((self.scores[touched].ravel(), score))
        ids = np.concatenate((self.ids[touched].ravel(), id_))
        order = np.lexsort((ids, ~scores, slots))  # ~s falls as s rises, and never overflows
        slots = slots[order]
        keep = order[np.arange(len(order)) - np.searchsorted(slots, slots) < k]
        self.scores[touched] = scores[keep].reshape(-1, k)
        self.ids[touched] = ids[keep].reshape(-1, k)


def _first_k(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k best allowed entries, of ties the first columns."""
    if np.count_nonzero(allowed) <= 4 * k * len(scores) or scores.shape[1] <= k:
        return np.nonzero(allowed)
    least = -np.inf if scores.dtype.kind == "f" else _LEAST
    masked = np.where(allowed, scores, least)
    cut = np.partition(masked, scores.shape[1] - k, axis=1)[:, -k, None]
    above, level = masked > cut, (masked == cut) & allowed
    level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | level)


class Segment:
    """Blocks of lists, held by one task, that packs of anchors are searched in."""

    def __init__(self, shape: Shape, centroids: np.ndarray) -> None:
        self.shape, self.centroids = shape, centroids
        self.lists: list[int] = []
        self.radii: list[float] = []
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]] = []

    def hold(self, own: int, radius: float, ids: bytes, labels: bytes, raw: bytes) -> None:
        ids = np.frombuffer(ids, np.int64)
        m = np.frombuffer(raw, self.shape.dtype).reshape(len(ids), self.shape.dim)
        self.lists.append(own)
        self.radii.append(radius)
        self.blocks.append((ids, np.frombuffer(labels, np.int64), m, float(np.linalg.norm(m.astype(np.float64), axis=1).max(initial=0))))

    def search(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, floor: np.ndarray, k: int) -> Best:
        """The k best of each anchor (row) and window (column of low, high and floor)."""
        n, windows = low.shape
        best = Best(n * windows, k, floor.ravel())
        if not self.blocks:
            return best
        exact = q.astype(np.float64)
        size = np.linalg.norm(exact, axis=1)
        c = self.centroids[self.lists]
        middle, reach = exact @ c.T, size[:, None] * np.array(self.radii)
        slack = 1e-9 * (size[:, None] * np.linalg.norm(c, axis=1) + reach) + 1e-6
        upper, lower = middle + reach + slack, middle - reach - slack
        own_low, own_high = low.astype(np.float64), high.astype(np.float64)
        most = upper.max(axis=0)
        for b in np.argsort(-most, kind="stable"):
            kth = best.kth.reshape(n, windows)
            wanted = low <= high
            if most[b] < np.where(wanted, kth, _GREATEST).min(initial=_GREATEST):
                break  # so is every later block's bound
            u, v = upper[:, b, None], lower[:, b, None]
            open_ = np.flatnonzero((wanted & (u >= kth) & (u >= own_low) & (v <= own_high)).any(axis=1))
            if not len(open_):
                continue
            block_ids, block_labels, m, norm = self.blocks[b]
            scores = self._scores(q[open_], m, float(size[open_].max()) * norm)
            fits = (labels[open_, None] == block_labels) == same
            fits &= ids[open_, None] != block_ids
            for w in range(windows):
                slots = open_ * windows + w
                # Bounds as the scores' type: exact there, or beyond all scores.
                least = _as(np.maximum(low[open_, w], best.kth[slots]), scores)
                allowed = fits & (scores >= least[:, None]) & (scores <= _as(high[open_, w], scores)[:, None])
                rows, cols = _first_k(scores, allowed, k)
                if len(rows):
                    best.add(slots[rows], scores[rows, cols].astype(np.int64), block_ids[cols])
        return best

    def _scores(self, q: np.ndarray, m: np.ndarray, bound: float) -> np.ndarray:
        """Exact products. Any partial sum is at most the product of the norms."""
        for kind, limit in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
            if bound * (1 + 1e-9) < limit:
                return q.astype(kind) @ m.astype(kind).T
        return vectors.exact_products(q.astype(np.int64), m.astype(np.int64), self.shape.most)


def _as(bounds: np.ndarray, scores: np.ndarray) -> np.ndarray:
    if scores.dtype.kind == "i":
        return bounds
    limit = 1 << (24 if scores.dtype == np.float32 else 53)
    return np.where(bounds >= limit, np.inf, np.where(bounds <= -limit, -np.inf, bounds)).astype(scores.dtype)


# ---------------------------------------------------------------- searches over all segments


CANDIDATES = "pack long, row array<int>, id array<long>, score array<long>"


def _search(blocks: DataFrame, segments: tuple[int, int, int], asked: DataFrame, shape: Shape, centroids: np.ndarray, same: bool, k: int) -> DataFrame:
    """What segments first to last (of all) hold for packs with ``low``, ``high`` and ``floor``.

    Rows of CANDIDATES: distinct (anchor, id, score) that are among the k best of a window
    there. Each partition has one segment's blocks, then a group of packs one after another.
    """
    first, last, of = segments
    groups = max(1, -(-shape.anchors // ANCHOR_ROWS))
    part = lambda segment, group: (segment - first) * groups + group
    held = blocks.withColumn("segment", F.pmod(F.xxhash64("ids", "vectors"), F.lit(of)).cast("int")).where(F.col("segment").between(first, last - 1))
    held = held.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    null = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    left = held.select(part(F.col("segment"), F.col("group")).cast("int").alias("part"), F.lit(0).alias("kind"), "list", "radius", *null(("pack", "long")), "ids", "labels", "vectors", *null(("low", "binary"), ("high", "binary"), ("floor", "binary")))
    spread = asked.withColumn("segment", F.explode(F.sequence(F.lit(first), F.lit(last - 1)))).withColumn("group", F.pmod(F.xxhash64("pack"), F.lit(groups)))
    right = spread.select(part(F.col("segment"), F.col("group")).cast("int").alias("part"), F.lit(1).alias("kind"), *null(("list", "int"), ("radius", "double")), "pack", "ids", "labels", "vectors", "low", "high", "floor")
    stream = left.unionAll(right).repartitionById((last - first) * groups, "part").sortWithinPartitions("part", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment(shape, centroids)
        for batch in common.bounded(batches):
            for r in batch.to_pylist():
                if not r["kind"]:
                    segment.hold(r["list"], r["radius"], r["ids"], r["labels"], r["vectors"])
                    continue
                ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
                low, high, floor = (np.frombuffer(r[c], np.int64).reshape(len(ids), -1) for c in ("low", "high", "floor"))
                q = np.frombuffer(r["vectors"], shape.dtype).reshape(len(ids), shape.dim)
                best = segment.search(ids, labels, q, same, low, high, floor, k)
                anchor = np.repeat(np.arange(len(ids)), low.shape[1] * k)
                there = best.scores.ravel() != _LEAST
                # Windows share candidates; repeated rows (same id and score) stay k times at most.
                kept = _union(anchor[there], np.tile(np.repeat(np.arange(low.shape[1]), k), len(ids))[there], best.ids.ravel()[there], best.scores.ravel()[there])
                if len(kept[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([r["pack"]], pa.int64()), *(pa.array([v], pa.list_(t)) for v, t in zip(kept, (pa.int32(), pa.int64(), pa.int64())))], ["pack", "row", "id", "score"])

    return stream.mapInArrow(search, CANDIDATES)


def _union(anchor: np.ndarray, window: np.ndarray, id_: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the windows' lists of each anchor; a row that stands n times in one list
    stands as often in the union as in the list that has it most often."""
    order = np.lexsort((window, id_, score, anchor))
    a, w, i, s = anchor[order], window[order], id_[order], score[order]
    if not len(a):
        return a, i, s
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (i[1:] != i[:-1]) | (s[1:] != s[:-1]) | (w[1:] != w[:-1])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
    nth = np.arange(len(a)) - start  # of equal rows in one window
    order = np.lexsort((nth, i, s, a))
    a, i, s, nth = a[order], i[order], s[order], nth[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (i[1:] != i[:-1]) | (s[1:] != s[:-1]) | (nth[1:] != nth[:-1])
    return a[keep], i[keep], s[keep]


def _best_of(rows: list[dict], low: np.ndarray, high: np.ndarray, k: int) -> Best:
    """The k best of each anchor and window among candidates of all segments."""
    n, windows = low.shape
    best = Best(n * windows, k, np.full(n * windows, _LEAST))
    if rows:
        anchor, id_, score = (np.concatenate([np.asarray(r[c], np.int64) for r in rows]) for c in ("row", "id", "score"))
        for w in range(windows):
            inside = (score >= low[anchor, w]) & (score <= high[anchor, w])
            best.add(anchor[inside] * windows + w, score[inside], id_[inside])
    return best


def _unpacked(table: pa.Table) -> tuple[dict, list[dict]]:
    """A group of one pack (kind 1) and its candidates (kind 0)."""
    rows = table.to_pylist()
    return next(r for r in rows if r["kind"]), [r for r in rows if not r["kind"]]


def _with_candidates(asked: DataFrame, found: DataFrame):
    """Packs and their candidates, grouped by pack: as many rows a group as segments."""
    columns = [c for c in asked.columns if c != "pack"]
    left = asked.select("pack", F.lit(1).alias("kind"), *columns, *(F.lit(None).cast(t).alias(n) for n, t in (("row", "array<int>"), ("id", "array<long>"), ("score", "array<long>"))))
    right = found.select("pack", F.lit(0).alias("kind"), *(F.lit(None).cast("binary").alias(c) for c in columns), "row", "id", "score")
    return left.unionAll(right).groupBy("pack")


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, low: Fraction = Fraction(3, 10), high: Fraction = Fraction(9, 10)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id, label, x (array<long>) and anchor (boolean), usable ones. An anchor's positives
    are its best others of the same label; of each, the negatives are the best rows of another
    label that score within low to high of the positive's score.
    """
    spark = rows.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    common.ship(spark)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "x", F.coalesce("anchor", F.lit(False)).alias("anchor"))
    found = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("x")).alias("dim"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")).first()
    if not found["anchors"]:
        return spark.createDataFrame([], result)
    shape = Shape(found["n"], found["anchors"], found["dim"], found["most"] or 0)
    if shape.most >= vectors.MOST:
        raise ValueError(f"a component is {vectors.MOST} or more")
    sample = rows.orderBy(F.xxhash64("id", "x")).limit(max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(1, shape.dim)))).select("x").toArrow()
    fitted = vectors.matrix(sample.column(0).combine_chunks(), shape.dim)
    centroids = kmeans(fitted, max(1, min(MOST_LISTS, int(shape.rows**0.5) // 2)))
    blocks, anchors = lists(rows, shape, centroids), packs(rows, shape, centroids)
    segments = max(-(-shape.rows // SEGMENT_ROWS), min(FEW_SEGMENTS, -(-shape.rows // FEW_ROWS)))

    def everything(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            n = [len(v.as_py()) for v in batch.column("ids")]
            full = lambda v: pa.array([np.full(k // 8, v, np.int64).tobytes() for k in n], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, full(_LEAST), full(_GREATEST), full(_LEAST)], [*batch.schema.names, "low", "high", "floor"])

    window = f"{PACKS}, low binary, high binary, floor binary"
    near = _search(blocks, (0, segments, segments), anchors.mapInArrow(everything, window), shape, centroids, True, positives)

    def windows(table: pa.Table) -> pa.Table:
        """The positives of a pack's anchors and the window of each; none: an empty window."""
        pack, candidates = _unpacked(table)
        n = len(pack["ids"]) // 8
        best = _best_of(candidates, np.full((n, 1), _LEAST), np.full((n, 1), _GREATEST), positives)
        # A window's ends as integers: n/d*s <= score <= n'/d'*s.
        there = best.scores != _LEAST
        score = np.where(there, best.scores, 0).astype(object)
        least = np.where(there, -((-low.numerator * score) // low.denominator), 1).astype(np.int64)
        most = np.where(there, (high.numerator * score) // high.denominator, 0).astype(np.int64)
        made = {k: pack[k] for k in ("pack", "ids", "labels", "vectors")} | {"low": least.tobytes(), "high": most.tobytes(), "floor": np.full(n * positives, _LEAST).tobytes(), "positive": best.ids.tobytes(), "positive_score": best.scores.tobytes()}
        return pa.Table.from_pylist([made], asked_schema)

    asked_schema = pa.schema([("pack", pa.int64()), *((k, pa.binary()) for k in ("ids", "labels", "vectors", "low", "high", "floor", "positive", "positive_score"))])
    asked = common.written(_with_candidates(anchors, near).applyInArrow(windows, f"{window}, positive binary, positive_score binary"), "windows")
    columns = ["pack", "ids", "labels", "vectors", "low", "high", "floor"]
    if segments < WAVES_FROM:
        hard = _search(blocks, (0, segments, segments), asked.select(*columns), shape, centroids, False, negatives)
    else:
        middle = -(-segments // 8)
        early = common.written(_search(blocks, (0, middle, segments), asked.select(*columns), shape, centroids, False, negatives), "early")

        def raised(table: pa.Table) -> pa.Table:
            """A pack with the kth scores that its candidates so far have."""
            pack, candidates = _unpacked(table)
            lows, highs = (np.frombuffer(pack[c], np.int64).reshape(-1, positives) for c in ("low", "high"))
            best = _best_of(candidates, lows, highs, negatives)
            return pa.Table.from_pylist([{k: pack[k] for k in columns} | {"floor": np.ascontiguousarray(best.scores[:, -1]).tobytes()}], pa.schema([asked_schema.field(c) for c in columns]))

        better = _with_candidates(asked.select(*columns), early).applyInArrow(raised, window)
        hard = early.unionAll(_search(blocks, (middle, segments, segments), better, shape, centroids, False, negatives))

    def chosen(table: pa.Table) -> pa.Table:
        pack, candidates = _unpacked(table)
        lows, highs = (np.frombuffer(pack[c], np.int64).reshape(-1, positives) for c in ("low", "high"))
        best = _best_of(candidates, lows, highs, negatives)
        there = best.scores != _LEAST
        slot, rank = np.nonzero(there)
        ids, positive, score = (np.frombuffer(pack[c], np.int64) for c in ("ids", "positive", "positive_score"))
        parts = (ids[slot // positives], positive[slot], (rank + 1).astype(np.int32), best.ids[there], score[slot], best.scores[there])
        return pa.Table.from_arrays([pa.array(p) for p in parts], ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return _with_candidates(asked, hard).applyInArrow(chosen, result)


def embeddings(df: DataFrame, anchor: Column, label: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The usable rows of a table of vectors as ``mine`` takes them: floor(scale * c)."""
    given = df.select(F.col(vec_id).alias("id"), (F.col("label") if label is None else label).alias("label"), F.col(vector).alias("vector"), anchor.alias("anchor"))
    return given.where(F.col("id").isNotNull() & F.col("label").isNotNull() & vectors.usable("vector")).select("id", "label", vectors.scaled("vector", scale).alias("x"), "anchor")
