"""Licence scans by a generalised suffix automaton over the tokens of licence templates.

The automaton of all templates is fed a text's words one by one; its state gives the
matching statistics: the longest run of words ending here that stands in some template,
and, up the suffix links, the shorter ones of the other templates and places. A match is a
run of ``MIN_MATCH`` words or more of a text and of a template that neither neighbour
extends. Matches are chained per template, in order of text and of template, with gaps of
at most ``MAX_GAP`` words of text, by dynamic programming for the greatest covered weight.

A template word weighs the more the fewer labels have it, so stock words ("licensed under
the") cover next to nothing. Where chains of several labels lie over one span, the one that
covers the most weight is its label.

Only words of the templates' vocabulary move the automaton, so numpy first finds the runs
of such words and Python sees nothing else.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, license_texts

MIN_MATCH = 2
MAX_GAP = 6
MIN_COVERAGE = 0.6

# Phrases that the scan's contract names, and their labels.
BASE_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: Notices, SPDX lines and whole texts.
TEMPLATES = license_texts.templates()
#: Said beside licences too, so the label only of texts that name no licence.
LAST_RESORT = frozenset({"proprietary"})


@dataclass
class State:
    length: int = 0
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    #: (template, end) of every place at which the state's words stand.
    ends: set[tuple[int, int]] = field(default_factory=set)
    #: (length, template, end): the places of the state and up its links, each once, with
    #: the length of the words that stand there.
    places: list[tuple[int, int, int]] = field(default_factory=list)


class SuffixAutomaton:
    """Of several token sequences."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.states = [State()]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                self.states[last].ends.add((k, at + 1))
        upward = sorted(range(1, len(self.states)), key=lambda s: self.states[s].length)
        for s in reversed(upward):
            self.states[self.states[s].link].ends |= self.states[s].ends
        for s in upward:
            own = self.states[s]
            own.places = [(own.length, *e) for e in sorted(own.ends)] + [p for p in self.states[own.link].places if p[1:] not in own.ends]

    def _copy(self, p: int, q: int, token: int) -> int:
        s = self.states
        s.append(State(s[p].length + 1, s[q].link, dict(s[q].next)))
        c = len(s) - 1
        s[q].link = c
        while p >= 0 and s[p].next.get(token) == q:
            s[p].next[token] = c
            p = s[p].link
        return c

    def _extend(self, last: int, token: int) -> int:
        s = self.states
        q = s[last].next.get(token)
        if q is not None:
            return q if s[q].length == s[last].length + 1 else self._copy(last, q, token)
        s.append(State(s[last].length + 1))
        new, p = len(s) - 1, last
        while p >= 0 and token not in s[p].next:
            s[p].next[token] = new
            p = s[p].link
        if p < 0:
            s[new].link = 0
        else:
            q = s[p].next[token]
            s[new].link = q if s[q].length == s[p].length + 1 else self._copy(p, q, token)
        return new

    def matches(self, tokens: list[int], least: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, stop, template, end in the template) of the matches of ``least`` tokens
        or more that no token before or after extends."""
        s, state, length = self.states, 0, 0
        live: dict[tuple[int, int], int] = {}  # template and its lead over the text: start
        for at, token in enumerate(tokens, 1):
            while state and token not in s[state].next:
                state = s[state].link
                length = s[state].length
            if token in s[state].next:
                state, length = s[state].next[token], length + 1
            now = {}
            if length >= least:
                for n, k, end in s[state].places:
                    if n < least:
                        break
                    now[k, end - at] = at - min(n, length)
            for (k, lead), start in live.items():
                if (k, lead) not in now:
                    yield start, at - 1, k, lead + at - 1
            live = now
        for (k, lead), start in live.items():
            yield start, len(tokens), k, lead + len(tokens)


Match = tuple[int, int, int, int]  # start and stop in the text, start and stop in the template


def chains(matches: list[Match], sums: np.ndarray, max_gap: int = MAX_GAP) -> list[tuple[float, int, int]]:
    """(covered weight, start, stop) of chains of a template's matches, heaviest first.

    sums: prefix sums of the template's weights. A chain goes forward in text and template;
    what a match repeats of the one before it isn't counted. Each match is in one chain.
    """
    matches = sorted(matches)
    longest = max((m[1] - m[0] for m in matches), default=0)
    best, before = [], []
    for i, (start, stop, low, high) in enumerate(matches):
        most, came = float(sums[high] - sums[low]), -1
        j = i - 1
        while j >= 0 and matches[j][0] >= start - max_gap - longest:
            skip = max(0, matches[j][1] - start, matches[j][3] - low)
            if skip < stop - start and start + skip - matches[j][1] <= max_gap:
                here = best[j] + float(sums[high] - sums[low + skip])
                if here > most:
                    most, came = here, j
            j -= 1
        best.append(most)
        before.append(came)
    used, out = [False] * len(matches), []
    for i in sorted(range(len(matches)), key=lambda i: (-best[i], i)):
        if used[i]:
            continue
        first, at = i, i
        while at >= 0 and not used[at]:
            used[at], first, at = True, at, before[at]
        out.append((best[i] - (best[at] if at >= 0 else 0.0), matches[first][0], matches[i][1]))
    return sorted(out, key=lambda c: (-c[0], c[1], c[2]))


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]) -> None:
        sequences = [text.split() for _, text in templates]
        base = [(label, text.split()) for label, text in phrases.items()]
        self.words = sorted({w for x in sequences for w in x} | {w for _, x in base for w in x})
        index = {w: i for i, w in enumerate(self.words)}
        self.labels = [label for label, _ in templates]
        self.base = [(label, [index[w] for w in x]) for label, x in base]
        self.automaton = SuffixAutomaton([[index[w] for w in x] for x in sequences])
        having: dict[str, set[str]] = {}
        for label, x in zip(self.labels, sequences):
            for w in x:
                having.setdefault(w, set()).add(label)
        n_labels = len(set(self.labels))
        self.sums = [np.concatenate(([0.0], np.cumsum([math.log((1 + n_labels) / len(having[w])) for w in x]))) for x in sequences]
        raw = " ".join(self.words).encode()
        hashes, _ = common.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[hashes >> np.uint64(48)] = True

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary index of each word, -1 if it has none."""
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(48)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        good = self.hashes[place] == hashes[at]
        out[at[good]] = self.order[place[good]]
        return out

    def scan(self, runs: list[tuple[int, list[int]]]) -> dict:
        """runs: (first word, tokens) of the runs of vocabulary words, in order."""
        places, base, by_template = [], set(), {}
        for first, tokens in runs:
            for label, phrase in self.base:
                n = len(phrase)
                for at in range(len(tokens) - n + 1):
                    if tokens[at] == phrase[0] and tokens[at : at + n] == phrase:
                        places.append(first + at)
                        base.add(label)
            for start, stop, k, end in self.automaton.matches(tokens, MIN_MATCH):
                by_template.setdefault(k, []).append((first + start, first + stop, end - (stop - start), end))
        found = [(weight, weight / self.sums[k][-1], start, stop, self.labels[k]) for k, own in by_template.items() for weight, start, stop in chains(own, self.sums[k])]
        spans = self._settled([c for c in found if c[1] >= MIN_COVERAGE])
        labels = base | {label for *_, label in spans}
        return {
            "places": sorted(places), "base": sorted(base), "labels": sorted(labels - LAST_RESORT or labels), "score": min(1.0, max((float(c[1]) for c in found), default=0.0)),
            "spans": sorted({(start, stop, label, round(float(part), 4)) for _, part, start, stop, label in spans}),
        }

    @staticmethod
    def _settled(found: list[tuple[float, float, int, int, str]]) -> list[tuple[float, float, int, int, str]]:
        """The chains of which no better one has the greater part. The heavier is the better,
        then the one that covers more of its template; of equals all stay."""
        worth = lambda c: (-round(float(c[0]), 6), -round(float(c[1]), 6))
        taken, kept = bytearray(max((c[3] for c in found), default=0)), []
        for _, group in itertools.groupby(sorted(found, key=lambda c: (*worth(c), c[2], c[4])), key=worth):
            free = [c for c in group if 2 * taken.count(1, c[2], c[3]) <= c[3] - c[2]]
            kept += free
            for c in free:
                taken[c[2] : c[3]] = b"\1" * (c[3] - c[2])
        return kept


EMPTY = {"places": [], "base": [], "labels": [], "score": 0.0, "spans": []}


def scan_block(scanner: Scanner, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, dict]]:
    """Words, and what the scan finds, of each text of a block."""
    hashes, first = common.word_hashes(data, off)
    tokens = scanner.tokens(hashes)
    hit = tokens >= 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    starts, stops = edge[::2], edge[1::2]
    cut = first[1:-1]
    cut = cut[(cut > 0) & (cut < len(hit))]
    cut = cut[hit[np.minimum(cut, max(len(hit) - 1, 0))] & hit[np.maximum(cut - 1, 0)]] if len(hit) else cut
    starts, stops = np.unique(np.concatenate((starts, cut))), np.unique(np.concatenate((stops, cut)))
    long = stops - starts >= MIN_MATCH
    starts, stops = starts[long], stops[long]
    rows = np.searchsorted(first, starts, "right") - 1
    runs: dict[int, list] = {}
    for row, a, b in zip(rows.tolist(), starts.tolist(), stops.tolist()):
        runs.setdefault(row, []).append((a - int(first[row]), tokens[a:b].tolist()))
    for row, n in enumerate(np.diff(first).tolist()):
        yield n, scanner.scan(runs[row]) if row in runs else EMPTY


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES) -> DataFrame:
    """Per document: doc_id, n_words, base_places, base_labels, labels, score and spans
    (first word, word after the last, label, coverage).

    Words are runs of digits, letters and any non-ASCII characters, A-Z as a-z. Columns other
    than doc_id and text are ignored, also those named as the result's are. score: the
    greatest coverage of any template. Null and empty texts have no words, no labels and
    score 0. Labels of chains over one
    span that cover as much, of the text and of their templates, all count. Repeated rows stay one
    by one; an empty table gives no rows. Texts of any length take time in proportion. One narrow pass; nothing is shuffled.
    """
    common.ship(docs.sparkSession)
    scanner = Scanner(templates, phrases)
    kind = pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("coverage", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            found = [x for _, data, off in common.blocks(batch.column("text")) for x in scan_block(scanner, data, off)]
            results = [r for _, r in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([r["places"] for r in results], pa.list_(pa.int64())), pa.array([r["base"] for r in results], pa.list_(pa.string())),
                    pa.array([r["labels"] for r in results], pa.list_(pa.string())), pa.array([r["score"] for r in results], pa.float64()),
                    pa.array([[dict(zip(("first", "stop", "label", "coverage"), s)) for s in r["spans"]] for r in results], pa.list_(kind)),
                ],
                ["doc_id", "n_words", "base_places", "base_labels", "labels", "score", "spans"],
            )

    schema = "doc_id long, n_words long, base_places array<long>, base_labels array<string>, labels array<string>, score double, spans array<struct<first:long,stop:long,label:string,coverage:double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema)


def license_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of ``scan_licenses``: counts, first and last base word, labels.

    first_word and last_word are null where no base phrase stands; odd input as there.
    """
    found = scan_licenses(docs)
    return found.select("doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min("base_places").alias("first_word"), F.array_max("base_places").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.size("spans").cast("long").alias("n_spans"))
