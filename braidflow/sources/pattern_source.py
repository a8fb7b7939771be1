"""``spark.read.format("pattern")``: files by a path pattern, wildcards as columns.

    register_pattern(spark)
    spark.read.format("pattern").load("logs/{day}/{host}.txt").where("day = '2024-05-01'")

Columns: the wildcards, ``path``, ``size`` and ``content`` (bytes). Equalities, IN and
comparisons of wildcards are pushed down to the listing: folders that an equality rules
out aren't listed, files that a filter rules out aren't opened.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..functions.patterns import WILDCARD, to_regex, wildcards
from ..functions.shipping import ship
from .archives import opened

#: Files of a partition: so many, or of so many bytes.
PART_FILES, PART_BYTES = 1000, 128 << 20

#: Filters that are decided by a wildcard's value, and how.
_TESTS: dict[type, Any] = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v,
}


def register_pattern(spark: SparkSession) -> None:
    """Make the format known to a session, and have Spark push filters to Python sources."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PatternSource)


class PatternSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pattern"

    def schema(self) -> StructType:
        names = wildcards(self._pattern())
        if clash := {"path", "size", "content"} & set(names):
            raise ValueError(f"wildcards can't be named {sorted(clash)}")
        return StructType([*(StructField(n, StringType()) for n in names), StructField("path", StringType()), StructField("size", LongType()), StructField("content", BinaryType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PatternReader(self._pattern(), schema)

    def _pattern(self) -> str:
        pattern = self.options.get("path")
        if not pattern:
            raise ValueError("give the path pattern to load()")
        return pattern


@dataclass
class FileGroup(InputPartition):
    files: list[tuple[str, int, tuple[str, ...]]]


class PatternReader(DataSourceReader):
    def __init__(self, pattern: str, schema: StructType) -> None:
        self.pattern, self.columns = pattern, [f.name for f in schema.fields]
        self.kept: list[tuple[str, type, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        names = set(wildcards(self.pattern))
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in _TESTS and len(column) == 1 and column[0] in names:
                self.kept.append((column[0], type(f), f.value))
            else:
                yield f

    def _passes(self, name: str, value: str) -> bool:
        return all(_TESTS[kind](value, x) for n, kind, x in self.kept if n == name)

    def listed(self) -> Iterator[tuple[str, int, tuple[str, ...]]]:
        """(path, size, wildcards' values) of the files that match and that no filter rules out;
        a folder is listed only if its own segments match."""
        store, whole = opened(self.pattern)
        segments = whole.split("/")
        root = next((i for i, s in enumerate(segments) if WILDCARD.search(s)), len(segments) - 1)
        kinds = [to_regex(s) for s in segments[root:]]

        def below(folder: str, k: int, values: dict[str, str]) -> Iterator[tuple[str, int, tuple[str, ...]]]:
            regex, names = kinds[k]
            last = k == len(kinds) - 1
            for entry in sorted(store.get_file_info(pafs.FileSelector(folder or "/", allow_not_found=True)), key=lambda e: e.path):
                m = re.match(regex, entry.base_name)
                if m is None or entry.base_name.startswith((".", "_")):
                    continue
                found = dict(zip(names, m.groups()))
                if not all(self._passes(n, v) for n, v in found.items()):
                    continue
                if last and entry.type == pafs.FileType.File:
                    yield entry.path, entry.size, tuple((values | found)[n] for n in wildcards(self.pattern))
                elif not last and entry.type == pafs.FileType.Directory:
                    yield from below(entry.path, k + 1, values | found)

        yield from below("/".join(segments[:root]) or ("/" if whole.startswith("/") else "."), 0, {})

    def partitions(self) -> list[InputPartition]:
        groups, held, size = [], [], 0
        for file in self.listed():
            if held and (len(held) == PART_FILES or size + file[1] > PART_BYTES):
                groups.append(FileGroup(held))
                held, size = [], 0
            held.append(file)
            size += file[1]
        return [*groups, FileGroup(held)] if held else groups or [FileGroup([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.pattern)
        names = wildcards(self.pattern)
        types = [pa.string()] * len(names) + [pa.string(), pa.int64(), pa.binary()]
        for path, size, values in partition.files:
            with store.open_input_stream(path) as f:
                row = [*values, path, size, f.read()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [*names, "path", "size", "content"])
