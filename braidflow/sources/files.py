"""Files through Hadoop's file system API, so that any store Spark reads will do.

A path without a scheme belongs to the session's default file system, as it does for
Spark's own readers; paths of the local one are looked at directly.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkRuntimeError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import WILDCARD, literal_root, match, match_column, substitute, to_regex

_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):(?=/)")


@dataclass(frozen=True)
class FileTimes:
    """Of a file, or of the parts of a table directory: the oldest and the newest time."""

    oldest: float
    newest: float


def session() -> SparkSession | None:
    """This thread's session, or the application's, if there is one."""
    try:
        return SparkSession.active()
    except PySparkRuntimeError:
        return None


def local_path(path: str) -> str | None:
    """The path on this machine's disk, or None if it is in another store."""
    scheme = _SCHEME.match(path)
    if scheme:
        return re.sub(r"^file:/+", "/", path) if scheme[1].lower() == "file" else None
    spark = session()
    if spark is None:
        return path
    return path if spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:") else None


def hadoop(path: str):
    """The path and its file system as Hadoop's objects."""
    spark = session()
    if spark is None:
        raise RuntimeError(f"{path} needs a Spark session")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(pattern: str) -> str:
    """A path or pattern as Spark names files: absolute, with its store's scheme and host
    unless that is the local disk."""
    local = local_path(pattern)
    root = literal_root(pattern if local is None else local)
    rest = (pattern if local is None else local)[len(root) :].lstrip("/") if root != "." else (pattern if local is None else local)
    if local is not None:
        whole = os.path.abspath(root)
    else:
        where, fs = hadoop(root)
        whole = where.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
    return f"{whole.rstrip('/')}/{rest}" if rest else whole


def _parts(where, fs) -> Iterator:
    """Statuses of the visible files below a directory of another store."""
    found = fs.listFiles(where, True)
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith("."):
            yield f


def _local_parts(path: str) -> Iterator[str]:
    return (os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if not f.startswith("."))


def file_times(path: str) -> FileTimes | None:
    """None if there is nothing. A directory counts by its visible parts; empty: nothing."""
    local = local_path(path)
    if local is None:
        where, fs = hadoop(path)
        if not fs.exists(where):
            return None
        status = fs.getFileStatus(where)
        times = [f.getModificationTime() / 1000 for f in ([status] if status.isFile() else _parts(where, fs))]
    else:
        times = [os.stat(p).st_mtime for p in ([local] if os.path.isfile(local) else _local_parts(local))]
    return FileTimes(min(times), max(times)) if times else None


def exists(path: str) -> bool:
    """Whether there is a file, or a directory with a visible part: no more is listed."""
    local = local_path(path)
    if local is not None:
        return os.path.isfile(local) or next(_local_parts(local), None) is not None
    where, fs = hadoop(path)
    return fs.exists(where) and (fs.getFileStatus(where).isFile() or next(_parts(where, fs), None) is not None)


def find_matches(pattern: str) -> list[tuple[str, dict[str, str]]]:
    """Paths that match, sorted, with their wildcards' values; files and table directories."""
    local = local_path(pattern)
    if local is None:
        where, fs = hadoop(hadoop_glob(pattern))
        whole = qualified(pattern)
        names = [match(whole, s.getPath().toString()) for s in (fs.globStatus(where) or [])]
        return sorted((substitute(pattern, m), m) for m in names if m is not None)
    names = [(p, match(local, p)) for p in glob.glob(glob_escape(local))]
    return sorted((p, m) for p, m in names if m is not None)


def glob_escape(pattern: str) -> str:
    """Shell glob of a pattern whose literal parts are taken literally."""
    out, at = [], 0
    for m in WILDCARD.finditer(pattern):
        out += [glob.escape(pattern[at : m.start()]), "*"]
        at = m.end()
    return "".join(out) + glob.escape(pattern[at:])


def hadoop_glob(pattern: str) -> str:
    """Hadoop glob of a pattern whose literal parts are taken literally."""
    literal = lambda s: re.sub(r"[\[\]{}*?\\]", r"\\\g<0>", s)
    out, at = [], 0
    for m in WILDCARD.finditer(pattern):
        out += [literal(pattern[at : m.start()]), "*"]
        at = m.end()
    return "".join(out) + literal(pattern[at:])


def discover(pattern: str) -> list[str]:
    """All files below the pattern's literal root, sorted."""
    local = local_path(pattern)
    if local is None:
        where, fs = hadoop(literal_root(pattern))
        return sorted(f.getPath().toString() for f in _parts(where, fs)) if fs.exists(where) else []
    root = literal_root(local)
    found = [os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs]
    return sorted(p[2:] if root == "." and p.startswith("./") else p for p in found)


def read_file(path: str) -> bytes:
    """One file's bytes, from any store."""
    local = local_path(path)
    if local is not None:
        with open(local, "rb") as f:
            return f.read()
    spark = session()
    if spark is None:
        raise RuntimeError(f"{path} needs a Spark session")
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def rename(source: str, target: str) -> None:
    """Move a file or folder to a place that is free; its parent folders are made."""
    here, there = local_path(source), local_path(target)
    if here is not None and there is not None:
        os.makedirs(os.path.dirname(os.path.abspath(there)), exist_ok=True)
        if os.path.lexists(there):
            raise OSError(f"{target} is taken")
        os.rename(here, there)
        return
    (old, fs), (new, _) = hadoop(source), hadoop(target)
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"could not move {source} to {target}")


def remove(path: str) -> None:
    """Delete a file or folder, if it is there."""
    where, fs = hadoop(path)
    fs.delete(where, True)


def plain_path(column: Column | str) -> Column:
    """A file column of Spark as a plain path: without ``file:`` and percent signs' codes."""
    path = F.regexp_replace(column, r"^file:/+", "/")
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


def qualify_column(column: Column | str) -> Column:
    """A listing's path as other libraries take it: a URI, or without a scheme if local."""
    return F.regexp_replace(column, r"^file:/+", "/")


def total_size(path: str) -> int:
    """Bytes of a file or of all below a folder; 0 if there is nothing."""
    local = local_path(path)
    if local is not None:
        return os.path.getsize(local) if os.path.isfile(local) else sum(os.path.getsize(p) for p in _local_parts(local))
    where, fs = hadoop(path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, modified and size of all files below ``root``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def matched_listing(spark: SparkSession, pattern: str) -> DataFrame:
    """``listing`` of the files that match, with ``wildcards`` as a map."""
    whole = qualified(pattern)
    regex, _ = to_regex(whole)
    files = listing(spark, literal_root(pattern))
    return files.withColumn("path", F.regexp_replace("path", r"^file:/+", "/")).where(F.col("path").rlike(regex)).withColumn("wildcards", match_column(F.col("path"), whole))


#: Tasks that list the paths of one read, each many of them.
LISTING_TASKS = 64


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While a reader is made: Spark lists many paths in one job of LISTING_TASKS tasks, not
    in one of a task per path."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(LISTING_TASKS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def part_regex(pattern: str) -> tuple[str, list[str]]:
    """The expression of a pattern's files, and of the parts below it where it is a folder."""
    regex, names = to_regex(qualified(pattern))
    return regex.removesuffix("$") + "(?:/.*)?$", names


def times_of(spark: SparkSession, pattern: str) -> dict[tuple[str, ...], FileTimes]:
    """The times of everything that matches, by its wildcards' values in their order.

    One listing and one aggregation, however many files there are (of the local disk one walk
    over it); what comes to the driver is a row per match.
    """
    regex, names = part_regex(pattern)
    if local_path(pattern) is not None:
        found = [(tuple(m[n] for n in names), file_times(p)) for p, m in find_matches(pattern)]
        return {k: t for k, t in found if t is not None}
    try:
        with few_listing_tasks(spark):
            files = listing(spark, hadoop_glob(pattern))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    path = F.regexp_replace("path", r"^file:/+", "/")
    keys = [f"__{i}" for i in range(len(names))]
    found = files.select(*(F.regexp_extract(path, regex, i + 1).alias(k) for i, k in enumerate(keys)), F.unix_micros("modified").alias("t"), path.rlike(regex).alias("__hit")).where("__hit")
    grouped = found.groupBy(*keys).agg(F.min("t").alias("oldest"), F.max("t").alias("newest"))
    return {tuple(r[k] for k in keys): FileTimes(r["oldest"] / 1e6, r["newest"] / 1e6) for r in grouped.toLocalIterator() if r["newest"] is not None}


def read_pattern(spark: SparkSession, pattern: str, source: str = "text", schema: str | None = None, where: Column | str | None = None, **options) -> DataFrame:
    """One scan over all matching files of one schema, the wildcards as columns.

    A coarse glob lists the files, the pattern's expression filters them. where: a condition
    on the wildcards, applied to a listing; other files aren't opened.
    """
    whole = qualified(pattern)
    regex, names = to_regex(whole)
    captures = [F.regexp_extract("__path", regex, i).alias(n) for i, n in enumerate(names, 1)]
    paths: str | list[str] = hadoop_glob(pattern)
    if where is not None:
        files = listing(spark, paths).select(F.regexp_replace("path", r"^file:/+", "/").alias("__path")).where(F.col("__path").rlike(regex))
        paths = [re.sub(r"[\[\]{}*?\\]", r"\\\g<0>", r["__path"]) for r in files.select("__path", *captures).where(where).select("__path").toLocalIterator()]
        if not paths and schema is None:
            raise FileNotFoundError(f"nothing of {pattern} is left; give a schema to get no rows")
    reader = spark.read.format(source).options(**options)
    reader = reader.schema(schema) if schema else reader
    if not paths:
        return spark.createDataFrame([], schema).select("*", *(F.lit(None).cast("string").alias(n) for n in names))
    with few_listing_tasks(spark):
        df = reader.load(paths)
    df = df.select("*", plain_path(F.col("_metadata.file_path")).alias("__path")).where(F.col("__path").rlike(regex))
    return df.select(*df.columns[:-1], *captures)
