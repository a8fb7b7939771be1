"""Near duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A text is the weighted set of its five-word shingles; a shingle's weight is its count times
an inverse document frequency over the whole corpus. Each of BANDS x ROWS samples picks a
shingle so that two texts agree with the probability of their weighted Jaccard similarity;
as many more, by minimal hashes, agree with that of the plain sets' similarity.
Texts that agree on a whole band of either kind meet in a bucket; pairs from buckets are
verified exactly and linked; linked texts form a class.

What keeps this linear where a group is huge:

* equal texts are one node, by a hash of the text, before anything else;
* a bucket of up to SMALL texts gives all its pairs; a larger one gives LEADERS of its
  texts with each other one. Then classes are formed, and the texts of large buckets that are not in
  one class yet are compared exactly by prefix filtering: with shingles in one order, rare
  ones first, two texts alike enough share one of the first few of each (how many follows
  from THRESHOLD and the texts' weights). So no link that joins two classes is lost between
  texts of a bucket, and texts that differ too much to be linked never meet there;
* these links form the classes and don't count them: the links of a text are counted over
  all pairs of its class, in blocks of texts, only where the counts are asked for;
* joins on the pairs are plain equi-joins, which adaptive execution splits if skewed;
* classes come from alternating star contractions over tables, nothing on the driver.

Document frequencies are kept in 2^20 counters by shingle hash (a bounded table whatever
the corpus), each the sum of its shingles'. The frequency enters as 1 + DAMPING x ln(N/df) /
ln(N), so a shingle everyone has still counts, and a copy's few own shingles can't outweigh
what it shares. A pair is linked at a weighted similarity of THRESHOLD, or at that
similarity of the plain shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
DAMPING = 0.25
BITS = 20
SLICE = 1 << 14
SMALL = 16
#: Texts of a larger bucket that are compared with all of it: the least of each residue class.
LEADERS = 2
#: A pair whose samples of both kinds agree less often than this isn't verified: 5 standard
#: deviations below THRESHOLD.
LEAST_AGREEMENT = 0.45

_U = np.uint64


def _gamma21_quantiles() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at (i + 1/2) / 2^16, by bisection of its distribution."""
    q = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(len(q)), np.full(len(q), 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        under = 1 - np.exp(-mid) * (1 + mid) < q
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


_tables: dict[str, np.ndarray] = {}


def _sampling_tables() -> dict[str, np.ndarray]:
    if not _tables:
        gamma = _gamma21_quantiles()
        _tables["r"] = gamma.astype(np.float32)
        _tables["log_c"] = np.log(gamma).astype(np.float32)
        factors = common.mix(np.arange(1, 2 * SAMPLES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
        _tables["factor"], _tables["plain"] = factors[:SAMPLES], factors[SAMPLES:]
    return _tables


def icws(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SAMPLES 64-bit samples of a weighted set: hashes of (key, level) by Ioffe's scheme."""
    t = _sampling_tables()
    best = np.full(SAMPLES, np.inf, np.float32)
    out = np.zeros(SAMPLES, _U)
    rows = np.arange(SAMPLES)
    log_w = np.log(weights).astype(np.float32)
    for at in range(0, len(keys), 4096):
        key = keys[at : at + 4096]
        x = key * t["factor"][:, None]
        x ^= x >> _U(29)
        r = t["r"][(x & _U(0xFFFF)).astype(np.intp)]
        log_c = t["log_c"][(x >> _U(16) & _U(0xFFFF)).astype(np.intp)]
        beta = (x >> _U(48)).astype(np.float32) * np.float32(1 / 65536)
        level = np.floor(log_w[at : at + 4096] / r + beta)
        a = log_c - r * (level - beta + 1)
        k = a.argmin(axis=1)
        low = a[rows, k]
        new = low < best
        best[new] = low[new]
        out[new] = common.mix(key[k] ^ (level[rows, k].astype(np.int64).astype(_U) * _U(0xD6E8FEB86659FD93)))[new]
    return out


def minwise(keys: np.ndarray) -> np.ndarray:
    """SAMPLES 64-bit samples of a plain set: its least hashes."""
    best = np.full(SAMPLES, ~_U(0), _U)
    for at in range(0, len(keys), 4096):
        x = keys[at : at + 4096] * _sampling_tables()["plain"][:, None]
        x ^= x >> _U(29)
        x *= _U(0xBF58476D1CE4E5B9)
        np.minimum(best, x.min(axis=1), out=best)
    return common.mix(best)


def text_shingles(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles, ascending, and their counts, of each text of a block."""
    words, first = common.word_hashes(data, off)
    hashes, cut = common.shingles(words, first, WIDTH)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = np.sort(hashes[a:b])
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if b > a else np.zeros(0, np.int64)
        yield own[edge], np.diff(np.append(edge, b - a))


# ---------------------------------------------------------------- document frequencies


def idf_table(docs: DataFrame) -> np.ndarray:
    """The 2^BITS weights by shingle hash; counts over all documents, summed in slices."""
    common.ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int32), 0
        for batch in common.bounded(batches):
            for _, data, off in common.blocks(batch.column("text")):
                for keys, _ in text_shingles(data, off):
                    total += 0 if not len(keys) else np.bincount((keys >> _U(64 - BITS)).astype(np.int64), minlength=1 << BITS).astype(np.int32) if len(keys) > 1 << 17 else 0
                    if len(keys) and len(keys) <= 1 << 17:
                        slots, times = np.unique((keys >> _U(64 - BITS)).astype(np.int64), return_counts=True)
                        total[slots] += times.astype(np.int32)
            n += batch.num_rows
        cut = range(0, 1 << BITS, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *(a // SLICE for a in cut)], pa.int32()), pa.array([n] + [0] * len(cut), pa.int64()), pa.array([b"", *(total[a : a + SLICE].tobytes() for a in cut)], pa.binary())], ["slice", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n = 0
        for batch in common.bounded(batches):
            for k, rows, raw in zip(*(c.to_pylist() for c in batch.columns)):
                n += rows
                if k >= 0:
                    sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int64 if len(raw) == 8 * SLICE else np.int32).astype(np.int64)
        out = [(-1, n, b""), *((k, 0, v.tobytes()) for k, v in sums.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))], ["slice", "n", "counts"])

    kind = "slice int, n long, counts binary"
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, kind)
    summed = parts.repartition(16, "slice").mapInArrow(add, kind)
    table, n = np.zeros(1 << BITS), 0
    for r in summed.toLocalIterator():
        n += r["n"]
        if r["slice"] >= 0:
            table[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] += np.frombuffer(r["counts"], np.int64)
    return (1 + DAMPING * np.maximum(0, np.log((n + 2) / (table + 1))) / np.log(n + 2)).astype(np.float32)


# ---------------------------------------------------------------- signatures


def _banded(samples: np.ndarray) -> np.ndarray:
    """A hash for each band of samples, of both kinds."""
    x = samples.reshape(2 * BANDS, ROWS)
    h = np.zeros(2 * BANDS, _U)
    for k in range(ROWS):
        h = common.mix(h * _U(0x9E3779B97F4A7C15) + x[:, k] + _U(k))
    return common.mix(h + np.arange(2 * BANDS, dtype=_U))


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, key (of the text), bands (hashes), and sketch (two bytes of each sample)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[bytes, bytes]] = {}
        for batch in common.bounded(batches):
            keys = batch.column("key").to_pylist()
            out: list[tuple[bytes, bytes]] = []
            for row, data, off in common.blocks(batch.column("text")):
                for k, (shingle, times) in enumerate(text_shingles(data, off), row):
                    got = seen.get(keys[k])
                    if got is None:
                        got = b"", b""
                        if len(shingle):
                            samples = np.concatenate((icws(shingle, times * shared.value[(shingle >> _U(64 - BITS)).astype(np.int64)]), minwise(shingle)))
                            got = _banded(samples).tobytes(), samples.astype("<u2").tobytes()
                        if len(seen) > 20_000:
                            seen.clear()
                        seen[keys[k]] = got
                    out.append(got)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["doc_id", "key", "bands", "sketch"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("key"), text.alias("text")).mapInArrow(run, "doc_id long, key binary, bands binary, sketch binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """bucket and node: a row for each band of each text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            h = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            node = np.repeat(np.asarray(batch.column("node"), np.int64), 2 * BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(node)], ["bucket", "node"])

    return nodes.where(F.length("bands") > 0).select("node", "bands").mapInArrow(run, "bucket long, node long")


# ---------------------------------------------------------------- verification


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose samples of either kind agree often enough to be verified."""
    samples = nodes.select("node", F.col("sketch").alias("samples"))
    both = pairs.join(samples.select(F.col("node").alias("a"), F.col("samples").alias("sa")), "a").join(samples.select(F.col("node").alias("b"), F.col("samples").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, 2, SAMPLES) for c in ("sa", "sb"))
            good = pa.array((x == y).mean(axis=2).max(axis=1) >= LEAST_AGREEMENT)
            yield batch.select(["a", "b"]).filter(good)

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _similarity(x: np.ndarray, y: np.ndarray, idf: np.ndarray) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of two packed shingle sets."""
    (kx, nx), (ky, ny) = ((v["key"], v["n"]) for v in (x, y))
    common_keys, i, j = np.intersect1d(kx, ky, assume_unique=True, return_indices=True)
    slot = lambda k: idf[(k >> _U(64 - BITS)).astype(np.int64)]
    whole = float((nx * slot(kx)).sum() + (ny * slot(ky)).sum())
    least = float((np.minimum(nx[i], ny[j]) * slot(common_keys)).sum())
    union = len(kx) + len(ky) - len(common_keys)
    return least / max(whole - least, 1e-12), len(common_keys) / max(union, 1)


PACKED = np.dtype([("key", "<u8"), ("n", "<u4")])


def _sets(docs: DataFrame) -> DataFrame:
    """node and its packed shingle set, for rows of node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            for row, data, off in common.blocks(batch.column("text")):
                packed = []
                for keys, times in text_shingles(data, off):
                    v = np.empty(len(keys), PACKED)
                    v["key"], v["n"] = keys, times
                    packed.append(v.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("node")[row : row + len(packed)], pa.array(packed, pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, idf: np.ndarray) -> DataFrame:
    """The pairs that are alike enough, with both similarities."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            both = [_similarity(np.frombuffer(x.as_py(), PACKED), np.frombuffer(y.as_py(), PACKED), shared.value) for x, y in zip(batch.column("sa"), batch.column("sb"))]
            good = pa.array([max(s) >= THRESHOLD for s in both], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([s for s, _ in both], pa.float64()), pa.array([s for _, s in both], pa.float64())], ["a", "b", "weighted", "plain"])
            yield out.filter(good)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, weighted double, plain double")


# ---------------------------------------------------------------- classes


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for the nodes of edges (a, b).

    Alternating large and small stars; each round is a table, and rounds end when the
    edges no longer change. The least neighbours are tables too: a join with them is of two
    plain tables, which adaptive execution splits where a node has a great part of the edges.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = common.written(now, "stars")
    while not _are_stars(now):
        ways = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.written(ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.written(large, "large-stars")
        down = common.written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = common.written(small, "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u has one edge (u, v < u), and no v is a u itself: then v is the least
    node of its component. (Of a node: its edges as u, and whether it is a v.)"""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("hub")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("hub").alias("hub")).where("out > 1 OR (out = 1 AND hub = 1)").isEmpty()


#: Nodes from here on are texts without a doc_id, by a hash; doc_ids are below it.
UNNAMED = 1 << 62
#: Ids (of 8 bytes) that are broadcast at most, after counting them.
BROADCAST_IDS = 1 << 20


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    """(doc_id, key and node of every row; node and label of the linked texts; the shingle sets
    of these and others; the weights).

    A node is the least doc_id of an equal text, or UNNAMED and more of one without doc_id.
    """
    spark = docs.sparkSession
    common.ship(spark)
    idf = idf_table(docs)
    signed = common.written(signatures(docs, idf), "samples")
    unnamed = F.lit(UNNAMED) + F.xxhash64("key").bitwiseAND(UNNAMED - 1)
    nodes = signed.groupBy("key").agg(F.coalesce(F.min("doc_id"), unnamed).alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = common.written(nodes, "nodes")
    rows = signed.select("doc_id", "key").join(nodes.select("key", "node"), "key")
    bands = _bands(nodes)
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("size"), F.array_compact(F.array(*(F.min(F.when(F.pmod(F.xxhash64("node"), F.lit(LEADERS)) == i, F.col("node"))) for i in range(LEADERS)))).alias("leaders")).where("size > 1")
    buckets = common.written(bands.join(sizes, "bucket"), "buckets")
    few = buckets.where(F.col("size") <= SMALL).groupBy("bucket").agg(F.array_sort(F.collect_set("node")).alias("all"))
    couples = F.expr("flatten(transform(all, (x, i) -> transform(slice(all, i + 2, size(all)), y -> struct(x AS a, y AS b))))")
    pairs = few.select(F.explode(couples).alias("p")).select("p.a", "p.b")
    many = buckets.where(F.col("size") > SMALL)
    led = many.select(F.explode("leaders").alias("leader"), "node").where("leader <> node")
    pairs = pairs.unionAll(led.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"))).distinct()
    likely = common.written(_plausible(pairs, nodes), "pairs")
    crowded = common.written(many.select("node").distinct(), "crowded")
    sets = _sets_of(docs, likely.select(F.col("a").alias("node")).unionAll(likely.select(F.col("b").alias("node"))).unionAll(crowded), nodes)
    links = common.written(_verified(likely, sets, idf).dropDuplicates(["a", "b"]), "links")
    labels = common.written(components(links), "labels")
    if not crowded.isEmpty():
        own = F.coalesce("label", "node").alias("label")
        labelled = common.written(crowded.join(labels, "node", "left").select("node", own), "labelled")
        sizes = labelled.groupBy("label").agg(F.count("*").alias("size"))
        met = _prefix_pairs(labelled.join(sizes, "label").join(sets, "node"), idf)
        more = common.written(_plausible(met, nodes).join(likely, ["a", "b"], "left_anti"), "pairs")
        new = _verified(more, sets, idf).dropDuplicates(["a", "b"])
        # What is linked already is one node now: only its label goes on.
        between = new.select("a", "b").join(labelled.toDF("a", "la"), "a").join(labelled.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        further = common.written(components(between), "labels").toDF("label", "further")
        known = labels.unionByName(labelled).distinct()
        labels = common.written(known.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")
    return rows, labels, sets, idf


def _sets_of(docs: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Shingle sets of the wanted nodes' texts, as a table.

    The texts don't move where the wanted ids can be broadcast; else they are dealt out but
    not sorted (the hash table of the join holds ids alone). Texts without doc_id are found by
    their key.
    """
    wanted = common.written(wanted.distinct(), "wanted")
    text = F.col("text").cast("string").alias("text")
    of = lambda ids: ids.hint("broadcast" if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else "shuffle_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), text).join(of(wanted.where(F.col("node") < UNNAMED)), "node", "left_semi")
    unnamed = wanted.where(F.col("node") >= UNNAMED)
    if not unnamed.isEmpty():
        keys = of(common.written(nodes.select("node", "key").join(unnamed, "node", "left_semi"), "unnamed"))
        others = docs.where("doc_id IS NULL").select(_text_key().alias("key"), text).join(keys, "key").select("node", "text").dropDuplicates(["node"])
        texts = texts.unionByName(others)
    return common.written(_sets(texts), "sets")


# ---------------------------------------------------------------- prefix filtering

#: Texts are matched within classes of total weight, each this much wider than the last.
CLASS_STEP = np.log(1.05)
_SLACK = 1 + 1e-6


def prefix_keys(elements: np.ndarray, rarity: np.ndarray, weights: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which a weighted set can meet a similar one, and whether as the lighter.

    Sets x and y, x no heavier, of a similarity of THRESHOLD or more share at least
    t / (1 + t) (Wx + Wy). Of elements in one global order all that they share stands at or
    after the first shared one, so that one's rest of the set weighs as much in both; it is
    among the keys of x as the lighter set, of its own class, and among those of y as the
    heavier, for the class of x.
    """
    return prefix_rows(elements, rarity, weights, salt)[:2]


def prefix_rows(elements: np.ndarray, rarity: np.ndarray, weights: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As ``prefix_keys``, with the weight from each key's element on, and the set's weight."""
    order = np.lexsort((elements, -rarity))
    elements, weights = elements[order], weights[order].astype(np.float64)
    rest = np.cumsum(weights[::-1])[::-1] * _SLACK
    total = float(weights.sum())
    t = THRESHOLD
    kind = lambda w: int(np.floor(np.log(w) / CLASS_STEP))
    own = int((rest >= 2 * t / (1 + t) * total).sum())  # rest falls, so these are the first
    keys, light, rests = [_keyed(elements[:own], kind(total), salt)], [np.ones(own, bool)], [rest[:own]]
    for c in range(kind(t * total / _SLACK), kind(total) + 1):
        least = max(np.exp(c * CLASS_STEP) / _SLACK, t * total)
        first = int((rest >= t / (1 + t) * (least + total)).sum())
        keys.append(_keyed(elements[:first], c, salt))
        light.append(np.zeros(first, bool))
        rests.append(rest[:first])
    keys = np.concatenate(keys)
    return keys, np.concatenate(light), np.concatenate(rests), np.full(len(keys), total)


def _keyed(elements: np.ndarray, kind: int, salt: int) -> np.ndarray:
    return common.mix(elements + _U((kind * 0x9E3779B97F4A7C15 + salt * 0xD6E8FEB86659FD93) % (1 << 64)))


def _prefix_pairs(sets: DataFrame, idf: np.ndarray) -> DataFrame:
    """Pairs (a, b) of different labels that prefix filtering can't rule out.

    sets: node, label, size (texts of the label), shingles. Both similarities count: of the weighted shingles with
    their counts (a shingle's second, third … time is an element of its own), and of the
    plain set. Under each key, the texts outside the largest class meet the others of the
    other side. Classes of weight and sides are rough, so a pair is kept only where the key's
    element leaves each text the weight that two of just their weights must share to be alike.
    """
    shared = sets.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                parts: list[tuple] = []
                for node, label, size, raw in zip(*(part.column(c).to_pylist() for c in ("node", "label", "size")), part.column("shingles")):
                    v = np.frombuffer(raw.as_py(), PACKED)
                    key, n = v["key"], v["n"].astype(np.int64)
                    if not len(key):
                        continue
                    weight = shared.value[(key >> _U(64 - BITS)).astype(np.int64)]
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    many = np.repeat(weight, n)
                    counted = np.repeat(key, n) + nth.astype(_U) * _U(0xA0761D6478BD642F)
                    for keys, light, rest, total in (prefix_rows(counted, many, many, 1), prefix_rows(key, weight, np.ones(len(key)), 2)):
                        parts.append((keys.view(np.int64), light, np.full(len(keys), node), np.full(len(keys), label), np.full(len(keys), size), rest, total))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["key", "light", "node", "label", "size", "rest", "total"])

    keys = common.written(sets.select("node", "label", "size", "shingles").mapInArrow(run, "key long, light boolean, node long, label long, size long, rest double, total double"), "prefixes")
    mixed = keys.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("core"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "core")
    mixed = common.written(mixed, "mixed")  # tables, so that the joins below can be split where a key is hot
    outside = keys.join(mixed, "key").where("label <> core").select("key", (~F.col("light")).alias("light"), F.col("node").alias("n"), F.col("label").alias("own"), F.col("rest").alias("r"), F.col("total").alias("w"))
    outside = common.written(outside, "outside")
    enough = F.least("r", "rest") >= THRESHOLD / (1 + THRESHOLD) * (F.col("w") + F.col("total"))
    met = outside.join(keys, ["key", "light"]).where("own <> label AND IF(light, total <= w, total >= w)").where(enough)
    return met.select(F.least("n", "node").alias("a"), F.greatest("n", "node").alias("b")).distinct()


# ---------------------------------------------------------------- links of a text

#: A block of a class has about this many bytes of shingle sets, and texts, at most.
BLOCK_SETS = 1 << 20
BLOCK_TEXTS = 512
#: Cells of the 0/1 matrices that are multiplied at a time.
CELLS = 1 << 21


Elements = tuple[np.ndarray, np.ndarray, np.ndarray]


def _overlap(x: Elements, y: Elements, nx: int, ny: int) -> np.ndarray:
    """Weight that each set of x shares with each of y; sets as (elements, weights, rows)."""
    shared, first, _ = np.intersect1d(x[0], y[0], return_indices=True)
    out = np.zeros((nx, ny))
    order = [np.argsort(v[0], kind="stable") for v in (x, y)]
    (xe, xr), (ye, yr) = ((v[0][o], v[2][o]) for v, o in zip((x, y), order))
    weights = x[1][first]
    step = max(1, CELLS // max(nx, ny))
    for at in range(0, len(shared), step):
        part = shared[at : at + step]
        marks = []
        for e, r, n in ((xe, xr, nx), (ye, yr, ny)):
            a, b = np.searchsorted(e, part[0], "left"), np.searchsorted(e, part[-1], "right")
            place = np.searchsorted(part, e[a:b])
            hit = part[place] == e[a:b]
            m = np.zeros((n, len(part)))
            m[r[a:b][hit], place[hit]] = 1
            marks.append(m)
        out += (marks[0] * weights[at : at + step]) @ marks[1].T
    return out


def alike(x: list[np.ndarray], y: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Which packed shingle sets of x are to be linked with which of y."""

    def elements(sets: list[np.ndarray]) -> tuple[Elements, Elements]:
        v, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        key, n = v["key"], v["n"].astype(np.int64)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        weight = idf[(key >> _U(64 - BITS)).astype(np.int64)].astype(np.float64)
        return (key, np.ones(len(key)), row), (np.repeat(key, n) + nth.astype(_U) * _U(0xA0761D6478BD642F), np.repeat(weight, n), np.repeat(row, n))

    good = np.zeros((len(x), len(y)), bool)
    for a, b in zip(elements(x), elements(y)):
        least = _overlap(a, b, len(x), len(y))
        whole = np.bincount(a[2], a[1], len(x))[:, None] + np.bincount(b[2], b[1], len(y))
        good |= least / np.maximum(whole - least, 1e-12) >= THRESHOLD
    return good


def link_counts(labels: DataFrame, sets: DataFrame, idf: np.ndarray) -> DataFrame:
    """node and n_links: how many texts of its class each one is to be linked with, over all pairs.

    A class of more than a block meets as pairs of blocks, each a group of its own.
    """
    shared = labels.sparkSession.sparkContext.broadcast(idf)
    members = labels.join(sets, "node")
    n_blocks = F.ceil(F.greatest(F.sum(F.length("shingles")) / BLOCK_SETS, F.count("*") / BLOCK_TEXTS)).cast("int")
    placed = members.join(members.groupBy("label").agg(n_blocks.alias("n_blocks")), "label")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), "n_blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    met = placed.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "shingles")

    def run(group: pa.Table) -> pa.Table:
        own, node = (np.asarray(group.column(c)) for c in ("own", "node"))
        packed = [np.frombuffer(v, PACKED) for v in group.column("shingles").to_pylist()]
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        counts = np.zeros(len(node), np.int64)
        if len(x) and len(y):
            good = alike([packed[k] for k in x], [packed[k] for k in y], shared.value)
            if i == j:
                np.fill_diagonal(good, False)
                counts[x] = good.sum(axis=1)
            else:
                counts[x], counts[y] = good.sum(axis=1), good.sum(axis=0)
        return pa.table({"node": node, "n_links": counts})

    return met.groupBy("label", "i", "j").applyInArrow(run, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))


def _classed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    """(doc_id, key, node and class_id of every row; node and label of the linked texts; the
    shingle sets of these and others; the weights)."""
    rows, labels, sets, idf = link(docs)
    rows = rows.join(labels, "node", "left").select("doc_id", "key", "node", F.coalesce("label", "node").alias("class_id"))
    return common.written(rows, "rows"), labels, sets, idf


def classes(docs: DataFrame, count_links: bool = False) -> DataFrame:
    """doc_id, class_id (the class's least doc_id, see below), n_copies (rows of the same text) and key
    (the text's SHA-256), a row per row of docs; with count_links also n_links, the other
    texts that its text is linked with, of all of its class.

    Equal texts are in one class, null as the empty text. Texts without a word are alike
    only if equal. Rows without doc_id are compared and linked as any others; a class of
    such rows alone has as class_id a number from 2^62 on that its texts' hashes decide
    (doc_ids are below that). Rows of one doc_id are taken as one document. An empty table
    gives no rows; columns beside doc_id and text are ignored.

    Counting links compares all pairs of a class, in blocks, so its time grows with the
    square of the largest class; forming the classes doesn't.
    """
    rows, labels, sets, idf = _classed(docs)
    copies = rows.groupBy("key").agg(F.count("*").alias("n_copies"))
    out = rows.join(copies, "key")
    if not count_links:
        return out.select("doc_id", "class_id", "n_copies", "key")
    out = out.join(link_counts(labels, sets, idf), "node", "left")
    return out.select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", "key")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are their class's least doc_id, with all their columns, whatever
    their names; of a class without any doc_id one text stays.

    Of rows with equal doc_id (or none) and text one stays: that whose other columns hash
    least, of those the one that comes first.
    """
    found, *_ = _classed(docs)
    named, unnamed = F.col("doc_id") == F.col("class_id"), F.col("doc_id").isNull() & (F.col("class_id") >= UNNAMED) & (F.col("node") == F.col("class_id"))
    stay = common.written(found.where(named | unnamed).select("doc_id", "key").distinct(), "kept")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), _text_key().alias("text_key"))
    one = rows.join(stay, rows["id"].eqNullSafe(stay["doc_id"]) & (rows["text_key"] == stay["key"]), "left_semi")
    if _repeats(docs):
        others = [F.col(f"row.`{f.name}`") for f in docs.schema if f.name != "text" and not isinstance(f.dataType, (T.MapType, T.VariantType))]
        one = one.groupBy("id", "text_key").agg(F.min_by("row", F.xxhash64(*others)).alias("row"))
    return one.select("row.*")


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def _text_key():
    """A text's SHA-256; null as the empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
