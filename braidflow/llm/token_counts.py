"""Token counts of whole texts by byte-pair merging over a heap and a linked list.

A text is cut at added tokens (one token each) and then into words by the byte-level
pattern. A word starts as one symbol a byte; the lowest-rank adjacent pair, the leftmost of
equal ones, is popped from a heap and merged in a linked list, until no pair has a rank.
The word's count is its symbols less its merges; no identifier is ever made. Counts of short
words are remembered in a bounded table, so that a word is merged about once a task.

What input gives: a null or empty text has 0 bytes and 0 tokens; a null doc_id is kept;
repeated rows are counted each; other columns, of whatever name, are ignored. A table
without rows gives one. A text, and a single word of it, may have any length: merging takes
n log n steps.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Counts remembered a task, and the longest word among them in characters.
REMEMBERED = 300_000
REMEMBERED_LENGTH = 48
#: Fixed value: how byte-level vocabularies cut texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is
    printable in Latin-1, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def merges(symbols: list[str], rank: dict[tuple[str, str], int]) -> int:
    """How often adjacent symbols merge, always the pair of the least rank, leftmost first."""
    n = len(symbols)
    at = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    of = rank.get
    # An entry is one number, the rank first, then the place of the left symbol.
    heap = [r * n + i for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := of(pair)) is not None]
    heapq.heapify(heap)
    merged = 0
    while heap:
        r, i = divmod(heapq.heappop(heap), n)
        j = after[i]
        # An entry is out of date if its left symbol is gone or its pair is another by now.
        if at[i] is None or j >= n or of((at[i], at[j])) != r:
            continue
        at[i] += at[j]
        at[j] = None
        merged += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := of((at[i], at[k]))) is not None:
                heapq.heappush(heap, r * n + i)
        if (p := before[i]) >= 0 and (r := of((at[p], at[i]))) is not None:
            heapq.heappush(heap, r * n + p)
    return merged


class _Remembered(dict):
    """Counts of words, made when first asked for."""

    def __init__(self, count) -> None:
        super().__init__()
        self._count = count

    def __missing__(self, word: str) -> int:
        n = self._count(word)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


class Counter:
    """Token counts by the vocabulary file of a byte-level BPE (``tokenizers`` JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model, cut = described["model"], described.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or described.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: dropout, whole words, prefixes and suffixes aren't supported")
        self.rank = {(tuple(m) if isinstance(m, list) else tuple(m.split(" "))): i for i, m in enumerate(model["merges"])}
        added = described.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path}: added tokens that take white space or whole words aren't supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self._letter = {b: c for b, c in enumerate(byte_letters())}
        self._words = regex.compile(WORDS)
        self._usual: set[str] = set()
        self._unusual: set[str] = set()
        self.by_word = _Remembered(lambda w: self.of_letters(w.encode().decode("latin-1").translate(self._letter)))
        self.by_letters = _Remembered(self.of_letters)

    def of_letters(self, letters: str) -> int:
        """Tokens of a word given in byte letters."""
        return len(letters) - merges(list(letters), self.rank)

    def __call__(self, text: str) -> int:
        if self.added is None:
            return self._plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        if text.isascii() or not self._has_unusual(text):
            return sum(map(self.by_word.__getitem__, self._words.findall(text)))
        return sum(self.by_letters[w] for w, _ in _library().pre_tokenize_str(text))

    def _has_unusual(self, text: str) -> bool:
        """Whether a character of the text is of another class (letter, number, space, other)
        to the library's pattern than to ours: the two follow different Unicode versions."""
        chars = set(text)
        for c in chars - self._usual - self._unusual:
            (self._usual if _class_here(c) == _class_there(c) else self._unusual).add(c)
        return not self._unusual.isdisjoint(chars)


@functools.cache
def _library():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False)


_CLASSES = [("a", regex.compile(r"\p{L}")), ("1", regex.compile(r"\p{N}")), ("!", regex.compile(r"[^\s\p{L}\p{N}]"))]


def _class_here(c: str) -> str:
    return next((k for k, r in _CLASSES if r.match(c)), " ")


def _class_there(c: str) -> str:
    """Characters of one class aren't cut apart."""
    return next((k for k, _ in _CLASSES if len(_library().pre_tokenize_str(k + c)) == 1), " ")


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter a worker and vocabulary, with what it remembers."""
    return Counter(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``) of every row.

    vocabulary: path of the JSON file, the same on all workers. One narrow pass; nothing is
    shuffled.
    """
    path = vocabulary or default_vocabulary()
    common.ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in common.bounded(batches):
            column = batch.column(2)
            n = [of(t.as_py()) if t.is_valid else 0 for t in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return given.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
