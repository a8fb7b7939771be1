"""Secrets against scanners written out by hand, and ownership against sets."""

import hashlib
import random
import string
import time
from collections import defaultdict

from braidflow.llm import secret_scan

NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = set(string.ascii_letters + string.digits + "+/_.=-")


def assignments(text):
    """Leftmost, non-overlapping, read character by character; those of short values dropped."""
    at, out = 0, []
    while at < len(text):
        name = next((n for n in NAMES if text[at : at + len(n)].lower() == n and text[at : at + len(n)].isascii()), None)
        if name is None:
            at += 1
            continue
        p = at + len(name)
        p += p < len(text) and text[p] in "\"'"
        while p < len(text) and text[p] == " ":
            p += 1
        if p >= len(text) or text[p] not in ":=":
            at += 1
            continue
        p += 1
        while p < len(text) and text[p] == " ":
            p += 1
        p += p < len(text) and text[p] in "\"'"
        stop = p
        while stop < len(text) and text[stop] in VALUE:
            stop += 1
        if stop == p:
            at += 1
            continue
        if stop - p >= 6:
            out.append(("assign", at, stop))
        at = stop
    return out


def runs(text, kind, head, letters, least):
    at, out = 0, []
    while at < len(text):
        stop = at + len(head)
        if text[at:stop] != head:
            at += 1
            continue
        while stop < len(text) and text[stop] in letters:
            stop += 1
        if stop == at + len(head):
            at += 1
            continue
        if stop - at >= least:
            out.append((kind, at, stop))
        at = stop
    return out


def base(text):
    found = assignments(text) + runs(text, "access", "AKIA", set(string.ascii_uppercase + string.digits), 20) + runs(text, "hex", "", set("0123456789abcdef"), 24)
    return sorted(found, key=lambda c: (c[1], ("assign", "access", "hex").index(c[0])))


def test_base_spans_against_a_scan_by_hand():
    rng = random.Random(1)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "api-key", '"', "'", " ", "  ", ":", "=", "\n", "abc", "abcdef", "AKIA", "AKIA" + "Z9" * 8, "0f" * 11, "0f" * 12, "é", "toKen", "/+_.=-", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        got = [c[:3] for c in secret_scan.candidates(text) if c[0] in secret_scan.BASE]
        assert got == base(text), text


def test_ownership_counts_each_owner_and_repository_once(spark):
    rng = random.Random(2)
    values = [f"v{i}value{i:04}" for i in range(12)]
    rows = []
    for i in range(300):
        own = [rng.choice(values[: rng.randint(1, 12)]) for _ in range(rng.randint(0, 3))]
        rows.append((i, " ".join(f"token={v}" for v in own), rng.choice(["r1", "r2", None]), rng.choice(["a", "b", "c", None])))
    rows += [(None, None, "r1", "a"), (7, "token=onerepo1", "only", "x"), (8, "token=onerepo1", "only", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repository string, owner string")
    places, owners, repositories = defaultdict(int), defaultdict(set), defaultdict(set)
    for _, text, repository, owner in rows:
        for part in (text or "").split():
            h = hashlib.sha256(part.removeprefix("token=").encode()).hexdigest()
            places[h] += 1
            owners[h].add(owner or "")
            repositories[h].add(repository or "")
    got = secret_scan.ownership(secret_scan.scan(docs, "repository", "owner")).collect()
    assert {r.hash: (r.n_places, r.n_owners, r.n_repositories, r.is_example) for r in got} == {h: (n, len(owners[h]), len(repositories[h]), len(owners[h]) >= 3 or len(repositories[h]) >= 3) for h, n in places.items()}


def test_time_is_in_proportion():
    for unit in ("eyJ-", "eyJabcdefgh.", "-----BEGIN ", "token=", "AKIA", "xoxa-", "ghp_", "a", "password "):
        text = unit * (1_000_000 // len(unit))
        began = time.monotonic()
        secret_scan.candidates(text)
        assert time.monotonic() - began < 10, unit
