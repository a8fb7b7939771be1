"""Tar archives: members as rows, from an index of headers, and rows as archives.

Archives and their parts are opened in tasks by pyarrow's file systems (local, HDFS, S3,
GCS by the path's scheme), which can seek: an archive's members are indexed by its headers
alone, and read by their offsets in as many tasks as their bytes ask for.
"""

from __future__ import annotations

import io
import re
import tarfile
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from . import files

#: Bytes of members that a task reads, about; one member is never split.
PART_BYTES = 128 << 20
INDEX = "archive string, name string, start long, size long, modified double"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A path's file system and its name there; without a scheme it is the local disk's."""
    if "://" not in path or path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    store, rest = re.match(r"^([^:]+://[^/]*)(.*)$", path).groups()  # a name may have what a URI may not
    found, root = pafs.FileSystem.from_uri(store + "/")
    return found, root.rstrip("/") + rest


def tar_index(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, start, size and modified of the regular members of all archives at a
    path (a file, folder or glob): headers are read, contents are skipped.

    Compressed archives (.gz, .tgz, .bz2, .xz) can't be skipped through and aren't taken.
    """
    ship(spark)
    archives = files.listing(spark, path).where("size > 0").select(files.qualify_column("path").alias("archive"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, inside = opened(name)
                found: dict[str, list[Any]] = {k: [] for k in ("archive", "name", "start", "size", "modified")}
                with store.open_input_file(inside) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                    end = 0
                    for m in tar:
                        end = m.offset_data + -(-m.size // 512) * 512 if m.isreg() else m.offset_data
                        if m.isreg():
                            for k, v in zip(found, (name, m.name, m.offset_data, m.size, float(m.mtime))):
                                found[k].append(v)
                        tar.members = []  # an archive may have any number of them
                        if len(found["name"]) == 10_000:
                            yield pa.RecordBatch.from_pydict(found)
                            found = {k: [] for k in found}
                    f.seek(end)
                    if (rest := f.read(512)) and rest.strip(b"\0") or 0 < len(rest) < 512:
                        raise OSError(f"{name} is cut off or damaged at {end}")
                yield pa.RecordBatch.from_pydict(found, pa.schema([("archive", pa.string()), ("name", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("modified", pa.float64())]))

    return archives.repartition(F.col("archive")).mapInArrow(index, INDEX)


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, size and content of every regular member: a large archive's over many
    tasks, by ranges of its bytes. A condition on names goes to the index (``where`` it,
    then ``tar_contents``)."""
    return tar_contents(tar_index(spark, path))


def tar_contents(index: DataFrame) -> DataFrame:
    """The contents of the members of an index, or of some of them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, handle, last = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["archive"] != last:
                    store, inside = opened(r["archive"])
                    handle, last = store.open_input_file(inside), r["archive"]
                handle.seek(r["start"])
                raw = handle.read(r["size"])
                if len(raw) < r["size"]:
                    raise OSError(f"{last} ends within {r['name']}")
                yield pa.RecordBatch.from_pydict({"archive": [last], "name": [r["name"]], "size": [r["size"]], "content": pa.array([raw], pa.binary())})

    ship(index.sparkSession)
    part = F.floor(F.col("start") / PART_BYTES)
    placed = index.repartition(F.col("archive"), part).sortWithinPartitions("archive", "start")
    return placed.select("archive", "name", "start", "size").mapInArrow(read, "archive string, name string, size long, content binary")


def write_tars(df: DataFrame, path: str, name: str = "name", content: str = "content") -> DataFrame:
    """Each partition's rows as one archive ``part-<n>.tar`` below a path; archive and members
    of each, which runs the job when read.

    A task writes beside the target and moves the whole archive into its place, so a second
    try, or a second runner, replaces it by the same.
    """
    ship(df.sparkSession)
    target = files.qualified(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, folder = opened(target)
        beside, final = f"{folder}/.part-{part:05}-{uuid.uuid4().hex[:12]}", f"{folder}/part-{part:05}.tar"
        store.create_dir(folder, recursive=True)
        n = 0
        with store.open_output_stream(beside) as f, tarfile.open(fileobj=f, mode="w|", format=tarfile.PAX_FORMAT) as tar:
            for batch in batches:
                for member, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    info, raw = tarfile.TarInfo(member), raw.as_py() or b""
                    info.size = len(raw)
                    tar.addfile(info, io.BytesIO(raw))
                    n += 1
        if not n:
            store.delete_file(beside)
            return
        store.move(beside, final)
        yield pa.RecordBatch.from_pydict({"archive": [final], "members": [n]})

    rows = df.select(F.col(name).cast("string"), F.col(content).cast("binary"))
    return rows.mapInArrow(write, "archive string, members long")
