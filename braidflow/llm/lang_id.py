"""Language ID by nearest centroids.

A text is a vector of hashed character 1- to 3-grams (letters lower-cased, anything else a
space), with logarithmic term frequencies, inverse document frequencies and unit length.
Each language has several centroids, found by spherical k-means over its training vectors;
the nearest one by cosine decides. A text is rejected if its distance is beyond what any
training text of a like length has, or if it has no letter.

The model is fitted on the driver from a bounded sample (``SAMPLE_DOCS`` documents over all
languages, drawn by a hash of doc_id); its size doesn't depend on the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIM = 4096
SAMPLE_DOCS = 2400
#: More languages than this aren't fitted on one driver: an error, never a loss of some.
MAX_LANGUAGES = 2000
CENTROIDS = 3
ROWS = 256
UNKNOWN = "und"
#: Rejection: a cosine below this part of the least one in training, by length.
SLACK = 0.5
SHARPNESS = 30.0
#: Vectors are multiples of its inverse, so that a sum of their products is the same in any
#: order: a text scores alike alone and in any batch.
GRAIN = 1 << 23

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, a row per text, and the letters of each text.

    A text stands between two spaces of its own, and no n-gram reaches beyond them.
    """
    if not texts:
        return np.zeros((0, DIM), np.int64), np.zeros(0, np.int64)
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(texts)) + 2
    is_letter = _letter_table()[codes]
    c = np.where(is_letter, codes, 32).astype(np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * DIM, sizes)
    out = np.zeros(len(texts) * DIM, np.int64)
    h = np.zeros(len(c), np.uint32)
    some = np.zeros(len(c), bool)
    for k, factor in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
        n = len(c) - k
        if n <= 0:
            break
        h = h[:n] + c[k:] * np.uint32(factor) + np.uint32(k)
        some = some[:n] | is_letter[k:]
        keep = np.flatnonzero(some & (row[:n] == row[k:]))
        x = h[keep]
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out += np.bincount(row[keep] + (x >> np.uint32(20)).astype(np.int64), minlength=len(out))
    return out.reshape(len(texts), DIM), np.add.reduceat(is_letter, np.concatenate(([0], np.cumsum(sizes)[:-1]))).astype(np.int64)


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), 15)


def on_grid(v: np.ndarray) -> np.ndarray:
    return np.rint(v * GRAIN) / GRAIN


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray  # language-major, CENTROIDS rows each
    owner: np.ndarray  # language of each centroid
    idf: np.ndarray
    least: np.ndarray  # least cosine by length class

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts.astype(np.float64)) * self.idf
        return on_grid(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float], list[bool]]:
        """Language, score, cosine and rejection of each text."""
        counts, letters = ngram_counts(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [True] * len(texts)
        cos = self.vectors(counts) @ self.centroids.T
        best = np.full((len(texts), len(self.languages)), -1.0)
        for k, own in enumerate(self.owner):
            best[:, own] = np.maximum(best[:, own], cos[:, k])
        pick = best.argmax(axis=1)
        top = best[np.arange(len(texts)), pick]
        odds = np.exp(SHARPNESS * (best - top[:, None])).sum(axis=1)
        known = letters > 0
        rejected = ~known | (top < SLACK * self.least[length_class(letters)])
        score = np.where(known, 1 / odds, 0.0)
        return [self.languages[p] if k else UNKNOWN for p, k in zip(pick.tolist(), known.tolist())], score.tolist(), np.where(known, np.clip(top, 0, 1), 0).tolist(), rejected.tolist()


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k centroids; starts at the mean's nearest row, then the farthest rows."""
    mean = x.mean(axis=0)
    seeds = [x[(x @ mean).argmax()]]
    while len(seeds) < min(k, len(x)):
        near = (x @ np.stack(seeds).T).max(axis=1)
        if near.min() > 0.999:
            break
        seeds.append(x[np.argsort(near, kind="stable")[len(near) // 20]])
    c = np.stack(seeds)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit_arrays(langs: list[str], counts: np.ndarray, letters: np.ndarray) -> Model:
    languages = sorted(set(langs))
    n = len(langs)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(axis=0))) + 1 if n else np.ones(DIM)
    model = Model(languages, np.zeros((0, DIM)), np.zeros(0, np.int64), idf, np.full(16, -1.0))
    if not n:
        return model
    x = np.empty((n, DIM), np.float32)  # the grid's numbers are exact in it
    for at in range(0, n, ROWS):
        x[at : at + ROWS] = model.vectors(counts[at : at + ROWS])
    own = np.array([languages.index(v) for v in langs])
    parts = [_spherical_kmeans(x[own == k], CENTROIDS) for k in range(len(languages))]
    model.centroids = on_grid(np.concatenate(parts))
    model.owner = np.concatenate([np.full(len(p), k) for k, p in enumerate(parts)])
    top = (x @ model.centroids.T).max(axis=1)
    kind = length_class(letters)
    for k in range(16):  # the bound of a length is that of all lengths up to it or the next longer one
        inside = top[kind >= k]
        model.least[k] = min(inside.min(), *(top[kind == k]), 1.0) if (kind == k).any() else (inside.min() if len(inside) else model.least[k - 1])
    model.least[:5] = -1.0  # under 32 letters nothing is far enough to be told
    return model


def fit(docs: DataFrame, is_training: Column, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit from rows with text and lang for which ``is_training`` holds.

    About ``sample_docs`` rows over all languages (5 of each at least, twice that in all at
    most), those of the least hashes of doc_id and text.
    """
    common.ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(is_training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not found:
        return fit_arrays([], np.zeros((0, DIM)), np.zeros(0))
    each = max(5, sample_docs // len(found))
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, each / r["count"]))])
    picked = rows.withColumn("rank", F.xxhash64("doc_id", "text", F.lit(29))).where(F.pmod("rank", F.lit(1_000_003)) / 1_000_003 < F.coalesce(share[F.col("lang")], F.lit(0.0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            texts, langs, ranks = common.texts(batch.column("text")), batch.column("lang"), batch.column("rank")
            for at in range(0, len(texts), ROWS):
                c, letters = ngram_counts(texts[at : at + ROWS])
                packed = [zlib.compress(x.tobytes(), 1) for x in np.minimum(c, 65535).astype(np.uint16)]
                yield pa.RecordBatch.from_arrays([langs[at : at + ROWS], ranks[at : at + ROWS], pa.array(packed, pa.binary()), pa.array(letters, pa.int64())], ["lang", "rank", "counts", "letters"])

    counted = picked.select("lang", "rank", "text").mapInArrow(count, "lang string, rank long, counts binary, letters long").where("letters > 0")
    got = counted.orderBy("rank", "lang").limit(2 * max(sample_docs, each * len(found))).collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["counts"])))
    counts = np.zeros((len(got), DIM), np.uint16)
    for row, r in zip(counts, got):
        row[:] = np.frombuffer(zlib.decompress(r["counts"]), np.uint16)
    return fit_arrays([r["lang"] for r in got], counts, np.array([r["letters"] for r in got]))


def predict(docs: DataFrame, model: Model, keep: list[str], text_too: bool = False) -> DataFrame:
    """``keep`` columns (with text_too, text can be one) and lang_pred, lang_score, lang_cosine, lang_rejected, from text only.

    Null text counts as empty; a text without a letter is ``und``, score 0, rejected. Of
    languages at one distance the first by name is taken. Rows stay one by one, repeated
    ones too; a kept column of a new column's name is replaced. No rows of an empty table.
    Texts are read whole; memory is that of a block of texts, or of one long one.
    """
    spark = docs.sparkSession
    keep = [c for c in keep if c.lower() not in ("lang_pred", "lang_score", "lang_cosine", "lang_rejected", "__text")]
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*keep) if text_too else docs.select(*keep, F.col("text").cast("string").alias("__text"))
    name_of_text = "text" if text_too else "__text"
    schema = docs.select(*keep).schema
    for name, kind in (("lang_pred", "string"), ("lang_score", "double"), ("lang_cosine", "double"), ("lang_rejected", "boolean")):
        schema = schema.add(name, kind)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            texts = common.texts(batch.column(name_of_text))
            out: tuple[list, ...] = ([], [], [], [])
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and stop - at < ROWS and (size == 0 or size + len(texts[stop]) < common.BLOCK_BYTES):
                    size += len(texts[stop]) + 1
                    stop += 1
                for whole, part in zip(out, shared.value.predict(texts[at:stop])):
                    whole.extend(part)
                at = stop
            kept = [batch.column(i) for i in range(len(keep))]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, k) for x, k in zip(out, kinds))], [*keep, "lang_pred", "lang_score", "lang_cosine", "lang_rejected"])

    return source.mapInArrow(score, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learns from rows not held out.

    held_out: crc32 of the doc_id's text modulo 4 is 2 (null doc_id: held out). Null and
    empty texts, and all texts where nothing is learned: ``und``, score 0, rejected. See
    ``predict`` for the rest.
    """
    held = F.coalesce(common.crc32_mod("doc_id", 4) == 2, F.lit(True))
    model = fit(docs, ~held)
    return predict(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
