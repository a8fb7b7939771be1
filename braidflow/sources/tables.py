"""Scans and sinks of step values: tables, bytes, text, shell output, spilled values."""

from __future__ import annotations

import glob
import os
import pickle
import re
import shutil
import subprocess
import sys
import tempfile
import uuid
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import singledispatch
from typing import Any
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import literal_root, substitute, wildcards
from . import files


@dataclass(frozen=True)
class FilePath:
    """A path that the user names as a step's value; read when asked for."""

    path: str


@dataclass(frozen=True)
class Spilled:
    """A DataFrame kept in the session's storage (memory, then disk) between steps."""

    table: DataFrame


@dataclass(frozen=True)
class SpilledValue:
    """A large plain value kept in a file between steps."""

    path: str


@dataclass(frozen=True)
class SpilledText:
    """Command output kept in a file; unlike a pipe it can be read any number of times."""

    path: str


@singledispatch
def materialize(value: Any) -> Any:
    """What a value stands for; plain values are themselves. Register types to extend."""
    return value


@materialize.register
def _(value: FilePath) -> bytes:
    return files.read_file(value.path)


@materialize.register
def _(value: SpilledValue) -> Any:
    with open(value.path, "rb") as f:
        return pickle.load(f)


@materialize.register
def _(value: Spilled) -> DataFrame:
    return value.table


@materialize.register
def _(value: SpilledText) -> str:
    with open(value.path, encoding="utf-8", errors="replace") as f:
        return f.read()


@singledispatch
def materialize_table(value: Any, spark: SparkSession | None = None, **options: Any) -> DataFrame:
    """A value as a table. CSV files have a header and inferred types unless told otherwise."""
    raise TypeError(f"no table from {type(value).__name__}")


@materialize_table.register
def _(value: DataFrame, spark: SparkSession | None = None, **options: Any) -> DataFrame:
    return value


@materialize_table.register
def _(value: Spilled, spark: SparkSession | None = None, **options: Any) -> DataFrame:
    return value.table


@materialize_table.register
def _(value: FilePath, spark: SparkSession | None = None, **options: Any) -> DataFrame:
    return read_table(spark or SparkSession.active(), value.path, **options)


@materialize_table.register
def _(value: str, spark: SparkSession | None = None, **options: Any) -> DataFrame:
    return read_table(spark or SparkSession.active(), value, **options)


def read_csv(spark: SparkSession, path: str | list[str], **options: Any) -> DataFrame:
    return spark.read.options(**{"header": True, "inferSchema": True} | options).csv(path)


def _kind(path: str) -> tuple[str, dict[str, Any]]:
    """The format that a name's ending stands for (csv, tsv, txt, json, orc, also .gz; anything
    else is Parquet) and its settings."""
    stem = path.removesuffix(".gz").lower()
    if stem.endswith((".csv", ".tsv")):
        return "csv", {"header": True, "sep": "\t" if stem.endswith(".tsv") else ","}
    if stem.endswith((".txt", ".log")):
        return "text", {}
    return "json" if stem.endswith((".json", ".jsonl")) else "orc" if stem.endswith(".orc") else "parquet", {}


def read_table(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return _read(spark, path, path, **options)


def _read(spark: SparkSession, named: str, paths: str | list[str], **options: Any) -> DataFrame:
    kind, settings = _kind(named)
    if kind == "csv":
        return read_csv(spark, paths, **settings | options)
    return spark.read.options(**options).format(kind).load(paths)


def read_keyed(spark: SparkSession, pattern: str, values: Iterable[Mapping[str, str]], **options: Any) -> DataFrame:
    """One scan of the files (or table folders) of many assignments, the wildcards as columns.

    They have one schema. Rows come with the names that their file was matched by.
    """
    names = wildcards(pattern)
    if not names:
        return read_table(spark, pattern, **options)
    paths = sorted({substitute(pattern, v) for v in values})
    with files.few_listing_tasks(spark):
        df = _read(spark, pattern, [re.sub(r"[\[\]{}*?\\]", r"\\\g<0>", p) for p in paths], **options)
    if clash := [n for n in names if n in df.columns]:
        raise ValueError(f"columns {clash} of {pattern} have the names of its wildcards")
    regex, groups = files.part_regex(pattern)
    last = {n: i for i, n in enumerate(groups, 1)}
    path = files.plain_path(F.col("_metadata.file_path"))
    return df.select("*", *(F.regexp_extract(path, regex, last[n]).alias(n) for n in names))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def write_table(df: DataFrame, path: str, **options: Any) -> None:
    """Write beside the target and swap, so that a plan may still read what it replaces."""
    beside = f"{path}.tmp-{uuid.uuid4().hex[:12]}"
    _writer(df, path, options).save(beside)
    swap(beside, path)


def _writer(df: DataFrame, named: str, options: Mapping[str, Any]) -> Any:
    kind, settings = _kind(named)
    if named.endswith(".gz"):
        settings = settings | {"compression": "gzip"}
    return df.write.options(**settings | options).format(kind)


def swap(new: str, path: str) -> None:
    """Put a written result in its place.

    The old one is moved aside, not deleted, until the new one is there: cut short at any
    time, one of them is whole (as ``path``, as ``new`` or as ``path.old-…``).
    """
    aside = f"{path}.old-{uuid.uuid4().hex[:12]}"
    here = files.local_path(path)
    where, fs = (None, None) if here is not None else files.hadoop(path)
    replaced = os.path.lexists(here) if here is not None else fs.exists(where)
    if replaced:
        files.rename(path, aside)
    try:
        files.rename(new, path)
    except OSError:
        if replaced:
            files.rename(aside, path)
        raise
    if replaced:
        files.remove(aside)


#: Moves of finished parts at a time, in stores where each is a remote call.
MOVES = 16


def write_keyed(df: DataFrame, pattern: str, values: Iterable[Mapping[str, str]], **options: Any) -> None:
    """Each assignment's rows to its path, by one write however many paths there are.

    df has the pattern's wildcards as columns, which the files leave out. Rows are dealt by
    them, a large assignment's over several tasks; the parts are written beside the targets,
    then each is swapped into its place. An assignment without rows gets an empty table. Rows
    of no assignment are an error, and no target changes.
    """
    names = wildcards(pattern)
    if not names:
        return write_table(df, pattern, **options)
    if lost := [n for n in names if n not in df.columns]:
        raise ValueError(f"the table for {pattern} has no columns {lost}")
    targets = {tuple(v[n] for n in names): substitute(pattern, v) for v in values}
    beside = f"{literal_root(pattern)}/.keyed-{uuid.uuid4().hex[:12]}"
    keys = [f"__key{i}" for i in range(len(names))]
    rest = [c for c in df.columns if c not in names]
    keyed = df.select(*rest, *(F.col(n).cast("string").alias(k) for n, k in zip(names, keys)))
    try:
        _writer(keyed.hint("rebalance", *keys), pattern, options).partitionBy(*keys).save(f"{beside}/parts")
        made = {tuple(unquote(x.split("=", 1)[1]) for x in p.rsplit("/", len(names))[1:]): p for p in _folders(f"{beside}/parts", len(names))}
        if strange := sorted(set(made) - set(targets)):
            raise ValueError(f"rows of {len(strange)} assignments that weren't asked for, such as {dict(zip(names, strange[0]))}")
        if without := [t for t in targets if t not in made]:
            _writer(df.sparkSession.createDataFrame([], df.select(*rest).schema).coalesce(1), pattern, options).save(f"{beside}/none")
            for i, t in enumerate(without):
                made[t] = f"{beside}/none-{i}"
        moves = lambda t: _placed(made[t], targets[t], f"{beside}/none" if t in lacking else None)
        lacking = set(without)
        if files.local_path(pattern) is not None:
            for t in targets:
                moves(t)
        else:
            with ThreadPoolExecutor(MOVES) as pool:
                list(pool.map(moves, targets))
    finally:
        files.remove(beside)


def _placed(new: str, target: str, empty: str | None) -> None:
    if empty is not None:
        _copied(empty, new)
    swap(new, target)


def _copied(source: str, target: str) -> None:
    here = files.local_path(source)
    if here is not None:
        shutil.copytree(here, files.local_path(target))
        return
    (old, fs), (new, _) = files.hadoop(source), files.hadoop(target)
    spark = files.session()
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, old, fs, new, False, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"could not copy {source} to {target}")


def _folders(root: str, depth: int) -> list[str]:
    """The folders so many levels below ``root``."""
    here = files.local_path(root)
    if here is not None:
        return [p for p in glob.glob(glob.escape(here) + "/*=*" * depth) if os.path.isdir(p)]
    where, fs = files.hadoop(files.hadoop_glob(root) + "/*=*" * depth)
    return [s.getPath().toString() for s in (fs.globStatus(where) or [])]


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names, set for ``checkpoint`` too.

    Only where all executors are this process, and none is named, is it a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='braidflow-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_dir(spark: SparkSession, name: str) -> str:
    """This application's folder of a name in the shared one; deleted when the driver ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/braidflow-{spark.sparkContext.applicationId}{name}"
    if folder not in _scratch:
        _scratch.add(folder)
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return folder


_scratch: set[str] = set()


def spill(df: DataFrame) -> Spilled:
    """Keep a table for later steps; its first action fills the storage."""
    return Spilled(df.persist(StorageLevel.MEMORY_AND_DISK))


def weight(value: Any, looked_at: int = 1000) -> int:
    """About the bytes of a plain value; of a container from its first elements."""
    own = getattr(value, "nbytes", None)
    if isinstance(own, int):
        return own
    size = sys.getsizeof(value, 0)
    if isinstance(value, (list, tuple, set, frozenset, dict)) and value:
        some = [x for _, x in zip(range(looked_at), value.items() if isinstance(value, dict) else value)]
        size += sum(weight(x, 10) for x in some) * len(value) // len(some)
    return size


def spilled_if_large(value: Any, threshold: int, folder: str) -> Any:
    """The value, or where it lies if it is over the threshold and can be stored."""
    if value is None or isinstance(value, (FilePath, Spilled, SpilledText, SpilledValue)) or weight(value) <= threshold:
        return value
    path = os.path.join(folder, f"value-{uuid.uuid4().hex[:12]}.pickle")
    try:
        with open(path, "wb") as f:
            pickle.dump(value, f, pickle.HIGHEST_PROTOCOL)
    except (pickle.PicklingError, TypeError, AttributeError):
        os.remove(path)
        return value
    return SpilledValue(path)


def shell_lines(spark: SparkSession, command: str) -> DataFrame:
    """A command's standard output as lines (column ``value``), run in one task."""
    lines = spark.sparkContext.parallelize([], 1).pipe(f"sh -c {_quoted(command)}", checkCode=True)
    return lines.map(lambda x: (x,)).toDF("value string")


def through_shell(df: DataFrame, command: str) -> DataFrame:
    """Lines (the first column) through a command, once per partition, in parallel."""
    out = df.select(F.col(df.columns[0]).cast("string")).rdd.map(lambda r: r[0] or "").pipe(f"sh -c {_quoted(command)}", checkCode=True)
    return out.map(lambda x: (x,)).toDF("value string")


def _quoted(command: str) -> str:
    return "'" + command.replace("'", "'\\''") + "'"


def capture(command: str | list[str], threshold: int | None, folder: str | None, scope: Any = None) -> tuple[int, str | SpilledText, str]:
    """Run on the driver: exit code, standard output (in a file over threshold bytes) and
    the first 64 KiB of the error output. A scope can kill it with all that it started."""
    if threshold is None or folder is None:
        code, out, err = _watched(command, subprocess.PIPE, scope)
        return code, out.decode(errors="replace"), err
    path = os.path.join(folder, f"out-{uuid.uuid4().hex[:12]}")
    with open(path, "wb") as f:
        code, _, err = _watched(command, f, scope)
    if os.path.getsize(path) > threshold:
        return code, SpilledText(path), err
    with open(path, encoding="utf-8", errors="replace") as f:
        text = f.read()
    os.remove(path)
    return code, text, err


def _watched(command: str | list[str], stdout: Any, scope: Any) -> tuple[int, bytes, str]:
    with subprocess.Popen(command, shell=isinstance(command, str), stdout=stdout, stderr=subprocess.PIPE, start_new_session=True) as process:
        if scope is not None:
            scope.started(process)
        try:
            out, err = process.communicate()
        finally:
            if scope is not None:
                scope.ended(process)
    return process.returncode, out or b"", err.decode(errors="replace")[:65536]
