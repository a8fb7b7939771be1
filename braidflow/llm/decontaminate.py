"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised to lower-case words with single spaces. An item of m
bytes may be off by k = RATE x m edits: cut into k + 1 pieces, one of them must stand in
the text unchanged. An Aho-Corasick automaton finds all pieces of all items in one pass;
Myers' bit-parallel distance then verifies the surroundings of the hits. A short item is
searched with the spaces around it: as whole words, a missing boundary being an edit.

The items are a stated query set. They go to the tasks in blocks of at most
``BLOCK_BYTES`` of item text, whose automaton has a known size; more items take more
passes, each over all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATE = 0.08
#: Items of fewer normalised bytes are found as whole words.
WHOLE_WORDS_BELOW = 40
BLOCK_BYTES = 4 << 20


def normalised(data: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words in lower case with single spaces, and each byte's place in ``data``."""
    word = common.IS_WORD[data]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first byte after a word becomes the space
    if len(keep) and not word[-1]:
        last = np.flatnonzero(word)
        keep[last[-1] + 1 if len(last) else 0 :] = False
    at = np.flatnonzero(keep)
    out = np.where(word[at], common.LOWER[data[at]], 32).astype(np.uint8)
    return out.tobytes(), at


class Pattern:
    """An item, cut into pieces, and its masks for Myers' algorithm."""

    def __init__(self, item_id: int, text: bytes, rate: float, whole: bool = False) -> None:
        self.item_id, self.budget, self.item_bytes = item_id, int(rate * len(text)), len(text)
        self.whole = whole
        self.text = text = b" " + text + b" " if whole else text
        cuts = [len(text) * i // (self.budget + 1) for i in range(self.budget + 2)]
        self.pieces = [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.forward, self.backward = self._masks(text), self._masks(text[::-1])

    @staticmethod
    def _masks(text: bytes) -> list[int]:
        """For each byte the places at which it stands, as bits; in one pass over each byte's."""
        code = np.frombuffer(text, np.uint8)
        return [int.from_bytes(np.packbits(code == c, bitorder="little").tobytes(), "little") if there else 0 for c, there in enumerate(np.bincount(code, minlength=256).tolist())]


def myers(masks: list[int], m: int, text: bytes, anchored: bool) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of ``text``, and where that part ends.

    anchored: the part starts where the text does; otherwise anywhere. Of equal distances
    the first end wins.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    positive, negative, score = full, 0, m
    best, end = m, 0
    carry_in = 1 if anchored else 0
    for j, c in enumerate(text, 1):
        eq = masks[c]
        x = eq | negative
        d = ((((x & positive) + positive) ^ positive) | x) & full
        hp = negative | (~(d | positive) & full)
        hn = d & positive
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1 | carry_in) & full
        hn = (hn << 1) & full
        positive = hn | (~(d | hp) & full)
        negative = hp & d
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, bytes]], rate: float) -> None:
        import ahocorasick

        self.patterns = [Pattern(i, t, rate, len(t) < WHOLE_WORDS_BELOW) for i, t in items]
        owners: dict[bytes, list[tuple[int, int]]] = {}
        for k, p in enumerate(self.patterns):
            for offset, piece in p.pieces:
                owners.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), own))
        if owners:
            self.automaton.make_automaton()

    def find(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item's number, start, stop, distance): the best match of each place of an item.

        Places of an item whose surroundings overlap are one place. Start and stop are
        those of the words, without the spaces around a short item.
        """
        windows: dict[int, list[int]] = {}
        if not self.patterns:
            return []
        plain, padded = text, b" " + text + b" "
        for last, (size, own) in self.automaton.iter(padded.decode("latin-1")):
            inside = last + 1 - size >= 1 and last < len(padded) - 1
            for k, offset in own:
                if self.patterns[k].whole:
                    windows.setdefault(k, []).append(last + 1 - size - offset)
                elif inside:
                    windows.setdefault(k, []).append(last - size - offset)
        found = []
        for k, starts in windows.items():
            p = self.patterns[k]
            m, budget = len(p.text), p.budget
            text = padded if p.whole else plain
            if p.whole and not budget:  # a hit is the item
                found += [(k, s, s + m - 2, 0) for s in sorted(set(starts))]
                continue
            spans: list[list[int]] = []
            for s in sorted(set(starts)):
                a, b = max(0, s - budget), min(len(text), s + m + budget)
                if b - a < m - budget:
                    continue
                if spans and a < spans[-1][1] - m:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            for a, b in spans:
                distance, end = myers(p.forward, m, text[a:b], False)
                if distance <= budget:
                    tail = text[max(a, a + end - m - budget) : a + end][::-1]
                    _, length = myers(p.backward, m, tail, True)
                    start, stop = a + end - length, a + end
                    if p.whole:
                        while text[start] == 32:
                            start += 1
                        while text[stop - 1] == 32:
                            stop -= 1
                        start, stop = start - 1, stop - 1
                    found.append((k, start, stop, distance))
        return sorted(set(found))


def _blocks_of(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        text, _ = normalised(np.frombuffer(r["text"].encode(), np.uint8))
        if not text:
            continue
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    if block:
        yield block


MATCHES = "doc_id long, item_id long, start long, stop long, distance int, item_bytes int"
#: With the SHA-256 of the text.
KEYED = MATCHES + ", key string"


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, start and stop (code points of the text), distance, item_bytes.

    A row for each place of an item in a text within the error budget. Null texts and
    items, and items without a word or an item_id, match nothing; short ones can be told by
    item_bytes. Repeated rows repeat their matches, a repeated item doesn't; of places of
    an item at one distance that overlap, the first end counts. Either table empty: no
    rows. Columns beside doc_id, item_id and text are ignored. Texts of any length are
    searched whole. One narrow pass over the documents per block of items.
    """
    return _keyed_matches(docs, benchmark, rate).drop("key")


def _keyed_matches(docs: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame:
    spark = docs.sparkSession
    common.ship(spark)
    parts = []
    for block in _blocks_of(benchmark):
        shared = spark.sparkContext.broadcast(block)
        parts.append(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_searcher(shared, rate), KEYED))
    if not parts:
        return spark.createDataFrame([], KEYED)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


def _searcher(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate)
        for batch in common.bounded(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.utf8_texts(batch.column("text"))):
                data = np.frombuffer(text, np.uint8)
                plain, at = normalised(data)
                if found := matcher.find(plain):
                    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    key = hashlib.sha256(text).hexdigest()
                    for k, a, b, distance in found:
                        p = matcher.patterns[k]
                        rows.append({"doc_id": doc_id, "item_id": p.item_id, "start": int(points[at[a]]), "stop": int(points[at[b - 1] + 1]), "distance": distance, "item_bytes": p.item_bytes, "key": key})
            kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("distance", pa.int32()), ("item_bytes", pa.int32()), ("key", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in which no item stands, with all their columns.

    A document is its doc_id (null or not) and its text: others of the same doc_id stay.
    Null texts stay, and so do all documents if there are no items; repeated rows stay or
    go together. Columns may have any names.
    """
    found = _keyed_matches(docs, benchmark, rate).select("doc_id", "key")
    bad = common.written(found.distinct(), "contaminated")
    key = F.sha2(docs["text"].cast("string").cast("binary"), 256)
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (key == bad["key"]), "left_anti")
