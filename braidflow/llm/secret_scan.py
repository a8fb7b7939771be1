"""Secret scans with corpus-wide ownership frequency.

Each text gives candidates: the base kinds (``assign``, ``access``, ``hex``) and those of
``MORE``. A candidate's value is hashed, and the hashes are counted over the whole corpus
by distinct repository and owner. A value that many owners or repositories carry is a
copied example; one kept to an owner that also looks random is probably live.

A hot value is no hot task: each task first sums its own rows per (value, owner,
repository), and those sums, not the places, meet in the shuffle; owners and repositories
of a value are then counted each for themselves, from tasks' distinct ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The base kinds of the scan's contract, in its order, and the least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
# Public formats of keys and tokens beyond the base kinds.
MORE = {
    "github": (re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"), 0, 40),
    "jwt": (re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 30),
    "pem": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"), 0, 60),
    "slack": (re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), 0, 15),
    "google": (re.compile(r"\bAIza[A-Za-z0-9_-]{35}"), 0, 39),
}
#: A literal without which a kind can't be in a text.
NEEDS = {"access": "AKIA", "github": "gh", "jwt": "eyJ", "pem": "-----BEGIN", "slack": "xox", "google": "AIza"}
RANK = {kind: i for i, kind in enumerate([*BASE, *MORE])}
#: A value in as many owners or repositories is an example that people copy.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 3
LIVE_ENTROPY = 2.5


def entropy(value: str) -> float:
    """Bits a character of the value's own characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), by start and then kind: leftmost, non-overlapping per kind."""
    found = []
    for kind, (pattern, group, least) in (BASE | MORE).items():
        if kind in NEEDS and NEEDS[kind] not in text:
            continue
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((kind, m.start(), m.end(), m[group]))
    return sorted(found, key=lambda c: (c[1], RANK[c[0]]))


def joined(spans: list[tuple[str, int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


FOUND = "array<struct<kind:string,start:long,stop:long,hash:string,bits:double>>"


def scan(docs: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """One narrow pass: a row per document, with its candidates.

    row (unique), doc_id, repository, owner, n_assign, n_access, n_hex, base_sha256, spans
    and found (array of candidates; their values only as SHA-256).
    """
    common.ship(docs.sparkSession)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("hash", pa.string()), ("bits", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.bounded(batches):
            per = [candidates(t) for t in common.texts(batch.column("text"))]
            base = [[c for c in cs if c[0] in BASE] for cs in per]
            counts = [Counter(c[0] for c in cs) for cs in base]
            found = [[{"kind": k, "start": a, "stop": b, "hash": hashlib.sha256(v.encode()).hexdigest(), "bits": entropy(v)} for k, a, b, v in cs] for cs in per]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("repository"), batch.column("owner"), *(pa.array([c[k] for c in counts], pa.int64()) for k in BASE), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]), pa.array([joined(cs) for cs in per], pa.string()), pa.array(found, pa.list_(kind))],
                ["doc_id", "repository", "owner", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "found"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), F.col("text").cast("string"))
    counts = ", ".join(f"n_{k} long" for k in BASE)
    scanned = rows.mapInArrow(run, f"doc_id long, repository string, owner string, {counts}, base_sha256 string, spans string, found {FOUND}")
    return scanned.withColumn("row", F.monotonically_increasing_id())


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, n_places, n_owners, n_repositories and is_example, over the whole corpus.

    Null owners and repositories count as one owner and one repository, named ''. Repeated
    rows are places each; rows without candidates, and an empty table, give nothing; columns
    other than owner, repository and found are ignored.
    """
    places = scanned.select(F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository"), F.explode("found").alias("c"))
    by_place = places.groupBy(F.col("c.hash").alias("hash"), "owner", "repository").agg(F.count("*").alias("n"))
    by_hash = by_place.groupBy("hash").agg(F.sum("n").alias("n_places"), F.count_distinct("owner").alias("n_owners"), F.count_distinct("repository").alias("n_repositories"))
    return by_hash.withColumn("is_example", (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repositories") >= EXAMPLE_REPOSITORIES))


def secret_digest(docs: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """Per document the digest columns, and how many candidates are live-looking or examples.

    Null text: no candidates. Repeated rows and doc_ids stay apart, each a place of its
    own; spans of one start are in order of kind. An empty table gives no rows; columns
    beside those named are ignored, whatever their names. Texts of any length are read
    once, in time in proportion; what the scan found is written and read again.
    """
    scanned = common.written(scan(docs, repository, owner), "secrets")
    places = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("c")).select("row", "c.hash", "c.bits")
    by_row = places.join(ownership(scanned).select("hash", "is_example", "n_owners"), "hash").groupBy("row").agg(
        F.count_if("is_example").alias("n_example"), F.count_if(~F.col("is_example") & (F.col("bits") >= LIVE_ENTROPY)).alias("n_live"), F.max("n_owners").alias("most_owners")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return scanned.drop("found").join(by_row, "row", "left").select("doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", zero("n_example"), zero("n_live"), zero("most_owners"))
