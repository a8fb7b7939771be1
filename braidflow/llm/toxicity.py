"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic score of its words
and word beginnings; the document's is their noisy-or, 1 - prod(1 - p). Only documents are
labelled: the gradient of the noisy-or tells which sentences bear a label, and these are
what ``offending`` locates.

The model is fitted on the driver from a bounded sample: about ``SAMPLE_DOCS`` labelled
documents of each label, drawn by a hash of doc_id, and of these the texts of at most
``SAMPLE_BYTES`` bytes. It has ``MAX_FEATURES`` features at most. Scores are of whole texts
of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE_DOCS = 4000
SAMPLE_BYTES = 1 << 15
MAX_FEATURES = 4000
#: Features of a word: itself, and its beginnings of so many bytes.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
MIN_DOCS = 4
_TERMINATOR = np.zeros(256, bool)
_TERMINATOR[list(b".!?\n")] = True


@dataclass
class Bags:
    """The sentences of some texts: per text its first sentence, per word its sentence."""

    first: np.ndarray  # texts + 1
    sentence_of: np.ndarray  # words
    start: np.ndarray  # byte at which each sentence's first word starts
    stop: np.ndarray
    features: list[np.ndarray]  # per kind of feature: hashes of the words
    words: list[np.ndarray]  # and those words


def bags(data: np.ndarray, off: np.ndarray) -> Bags:
    """Sentences end at . ! ? or a line's end; those without a word don't count."""
    n = len(data)
    mask = common.IS_WORD[data]
    left = np.concatenate(([False], mask[:-1])) if n else mask
    left[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(mask & ~left)
    right = np.concatenate((mask[1:], [False])) if n else mask
    right[off[1:][off[1:] > 0] - 1] = False
    stops = np.flatnonzero(mask & ~right) + 1
    breaks = np.cumsum(_TERMINATOR[data])
    text_of = np.searchsorted(off, starts, "right") - 1
    key = breaks[starts] if n else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (key[1:] != key[:-1]) | (text_of[1:] != text_of[:-1])
    sentence = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.concatenate((heads[1:] - 1, [len(starts) - 1])) if len(heads) else heads
    first = np.searchsorted(text_of[heads], np.arange(len(off)))
    size = stops - starts
    everything = np.arange(len(starts))
    features, words = [common.span_hashes(data, starts, stops) ^ np.uint64(1)], [everything]
    for k in BEGINNINGS:
        long = np.flatnonzero(size >= k)
        features.append(common.span_hashes(data, starts[long], starts[long] + k))
        words.append(long)
    return Bags(first, sentence, starts[heads], stops[tails] if len(heads) else heads, features, words)


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    #: Of the fit: the loss it ended with, and its rounds.
    loss: float = float("nan")
    rounds: int = 0

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are features, and which features."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.keys, hashes[at]), max(len(self.keys) - 1, 0))
        good = self.keys[place] == hashes[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[good], place[good]

    def sentence_scores(self, b: Bags) -> np.ndarray:
        total = np.full(len(b.start), self.bias)
        for hashes, words in zip(b.features, b.words):
            at, feature = self.find(hashes)
            total += np.bincount(b.sentence_of[words[at]], self.weights[feature], len(total))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def noisy_or(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, of its sentences; 0 without any."""
    sums = np.concatenate(([0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))))
    return np.clip(-np.expm1(sums[first[1:]] - sums[first[:-1]]), 0, 1)


def fit_arrays(keys: np.ndarray, label: np.ndarray, n_sentences: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, rounds: int = 600, decay: float = 1e-4, least: float = 1e-3, every: int = 25) -> Model:
    """Maximise the labels' likelihood under the noisy-or, until ``every`` rounds lower the
    loss by less than its ``least`` part (or that of a tenth).

    doc, sentence, feature: a row for each time that a feature stands in a sentence (of the
    document); sentences without features only count.
    """
    n_docs = max(len(label), 1)
    pair, at = np.unique(doc * (1 << 32) + sentence, return_inverse=True)
    owner = pair >> 32
    bare = n_sentences - np.bincount(owner, minlength=len(label))
    w, b = np.full(len(keys), 2.0), -9.0
    step, m, v = 0.1, np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    balance = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1)) * n_docs
    loss, before = np.inf, np.inf
    for t in range(1, rounds + 1):
        z = b + np.bincount(at, w[feature], len(pair))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        p0 = 1 / (1 + np.exp(-b))
        log_none = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(label)) + bare * np.log1p(-p0)
        none = np.exp(log_none)
        loss = float((balance * np.where(label == 1, -np.log(np.maximum(1 - none, 1e-12)), -log_none)).mean() + decay / 2 * (w @ w))
        if t % every == 0:
            if before - loss < least * max(before, 0.1):
                break
            before = loss
        # d log-likelihood / d z of a sentence: p (y - P) / P for y = 1, -p for y = 0
        pull = np.where(label == 1, none / np.maximum(1 - none, 1e-9), -1.0) * balance
        dz = p * pull[owner]
        grad = np.append(np.bincount(feature, dz[at], len(keys)) / n_docs - decay * w, (dz.sum() + (p0 * bare * pull).sum()) / n_docs)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, b = w + move[:-1], min(b + move[-1], -4.0)
    return Model(keys, w, float(b), loss, t)


def _labelled(docs: DataFrame, labels: DataFrame, is_training: Column, each: int) -> DataFrame:
    """At most about ``each`` training documents of each label: the sample is bounded.

    A document of several rows counts once, with its first text in order; one of several
    labels is toxic if any says so.
    """
    known = labels.where(is_training & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, F.lit(min(1.0, each / max(counts.get(1, 0), 1)))).otherwise(F.lit(min(1.0, each / max(counts.get(0, 0), 1))))
    drawn = F.xxhash64("doc_id", F.lit(31))
    sample = known.where(F.pmod(drawn, F.lit(1_000_003)) / 1_000_003 < share).orderBy(drawn, "doc_id").limit(4 * each)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    return rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")


def fit(docs: DataFrame, labels: DataFrame, is_training: Column, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Choose features by how much oftener labelled documents have them, then fit."""
    spark = docs.sparkSession
    common.ship(spark)
    sample = common.written(_labelled(docs, labels, is_training, sample_docs), "toxic-sample")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            label = np.asarray(batch.column("label"), np.int64)
            for row, data, off in common.blocks(batch.column("text")):
                b, parts = bags(data, off), []
                text_of = np.searchsorted(b.first, np.arange(len(b.start)), "right") - 1
                for hashes, words in zip(b.features, b.words):
                    parts.append(np.stack((text_of[b.sentence_of[words]].astype(np.uint64), hashes)))
                pairs = np.unique(np.concatenate(parts, axis=1), axis=1)
                keys, at = np.unique(pairs[1], return_inverse=True)
                own = label[row + pairs[0].astype(np.int64)]
                pos = np.bincount(at, own, len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(pos), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64) - pos)], ["key", "pos", "neg"])

    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -20.0)
    lift = (F.col("pos") + 0.5) / (n1 + 1) / ((F.col("neg") + 0.5) / (n0 + 1))
    counted = sample.mapInArrow(spread, "key long, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    chosen = counted.where((F.col("pos") >= MIN_DOCS) & (lift > 4)).orderBy(F.desc(F.log(lift) * F.col("pos")), "key").limit(MAX_FEATURES).select("key").collect()
    keys = np.sort(np.array([r["key"] for r in chosen], np.int64).view(np.uint64))
    model = Model(keys, np.zeros(len(keys)), 0.0)
    shared = spark.sparkContext.broadcast(model)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            for row, data, off in common.blocks(batch.column("text")):
                b = bags(data, off)
                found = [[] for _ in range(len(off) - 1)]
                for hashes, words in zip(b.features, b.words):
                    at, feature = shared.value.find(hashes)
                    sentence = b.sentence_of[words[at]]
                    for t, s, f in zip((np.searchsorted(b.first, sentence, "right") - 1).tolist(), sentence.tolist(), feature.tolist()):
                        found[t].append((s - int(b.first[t])) << 32 | f)
                yield pa.RecordBatch.from_arrays([batch.column("label")[row : row + len(off) - 1], pa.array(np.diff(b.first), pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["label", "n", "found"])

    rows = sample.mapInArrow(gather, "label int, n long, found array<long>").collect()
    rows.sort(key=lambda r: (r["label"], r["n"], r["found"]))
    flat = np.array([x for r in rows for x in r["found"]], np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r["found"]) for r in rows])
    return fit_arrays(keys, np.array([r["label"] for r in rows]), np.array([r["n"] for r in rows]), doc, flat >> 32, flat & 0xFFFFFFFF)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_sentences, offending (code-point spans and scores of the sentences
    with a probability of at least a half), from the text alone.

    Null and empty texts, and texts without a word, have no sentence and score 0. Repeated
    rows are scored one by one and alike; other columns are ignored; an empty table gives
    no rows. A text of any length is scored whole, in time in proportion.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            for row, data, off in common.blocks(batch.column("text")):
                b = bags(data, off)
                p = shared.value.sentence_scores(b)
                total = noisy_or(p, b.first)
                found: list[list] = [[] for _ in range(len(off) - 1)]
                bad = np.flatnonzero(p >= 0.5)
                if len(bad):
                    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    text = np.searchsorted(b.first, bad, "right") - 1
                    for t, s in zip(text.tolist(), bad.tolist()):
                        zero = int(points[off[t]])
                        found[t].append({"start": int(points[b.start[s]]) - zero, "stop": int(points[b.stop[s]]) - zero, "score": float(p[s])})
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[row : row + len(off) - 1], pa.array(total), pa.array(np.diff(b.first), pa.int64()), pa.array(found, pa.list_(kind))], ["doc_id", "score", "n_sentences", "offending"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, n_sentences long, offending array<struct<start:long,stop:long,score:double>>")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the doc_id's text modulo 5 is 0; null: held out), score,
    predicted, n_sentences and n_offending. Learns from labels of rows not held out.

    Where only one label is known, no text is toxic. A score of exactly a half is
    predicted 1. Columns of any other name are ignored; see ``score`` for odd texts.
    """
    held = F.coalesce(common.crc32_mod("doc_id", 5) == 0, F.lit(True))
    scored = score(docs, fit(docs, labels, ~held))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", F.size("offending").cast("long").alias("n_offending"))
