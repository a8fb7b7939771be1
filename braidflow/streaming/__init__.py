"""Incremental runs as streams: only files that no earlier run has seen are read."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.patterns import has_wildcards, literal_root, to_glob, to_regex, wildcards
from ..sources.files import part_regex, plain_path

__all__ = ["make_from_new_files", "process_new_files"]


def process_new_files(spark: SparkSession, pattern: str, output: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], source: str = "text", schema: str | None = None, **options: str) -> None:
    """Run ``work`` on the rows of files that match and are new since the last call, append
    its rows to ``output`` (Parquet), and remember the files in ``checkpoint``.

    ``work`` must be row-wise or a stream aggregation in append mode; the wildcards are
    columns of its input. Exactly once, also if a run is cut short.
    """
    pattern = pattern.removeprefix("file://")
    regex, names = to_regex(pattern)
    reader = spark.readStream.format(source).options(**options).option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", to_glob(pattern).rsplit("/", 1)[-1])
    stream = (reader.schema(schema) if schema else reader).load(literal_root(pattern))
    matched = stream.select("*", plain_path(F.col("_metadata.file_path")).alias("__path")).where(F.col("__path").rlike(regex))
    captured = matched.select(*stream.columns, *(F.regexp_extract("__path", regex, i).alias(n) for i, n in enumerate(names, 1)))
    query = work(captured).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def make_from_new_files(spark: SparkSession, rules: Any, checkpoint: str, files_per_batch: int = 10_000, continuous: bool = False) -> StreamingQuery:
    """Run a rule, or a chain of rules, on the files that are new since the last call.

    The first rule's first input with wildcards is a stream of files, of which only the names
    are read. Each batch's assignments are made as by ``run``; what is up to date is skipped.
    So a target is made once per file: a batch that was made but not recorded (the driver
    ended between the two) comes again and finds its targets newer than its files. With
    ``continuous`` the query goes on waiting for files; else it ends when all are made.
    """
    from ..plans.rules import Rule, made_from

    first = rules if isinstance(rules, Rule) else rules.rules[0]
    pattern = next(p for p in first.inputs if has_wildcards(p))
    regex, groups = part_regex(pattern)
    names = wildcards(pattern)
    at = {n: i for i, n in enumerate(groups, 1)}
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(literal_root(pattern))
    path = F.regexp_replace("path", r"^file:/+", "/")
    found = files.select(path.alias("path")).where(F.col("path").rlike(regex)).select(*(F.regexp_extract("path", regex, at[n]).alias(n) for n in names))

    def make(batch: DataFrame, number: int) -> None:
        values = [r.asDict() for r in batch.distinct().collect()]  # of files_per_batch files at most
        if values:
            made_from(rules, values).run(batch.sparkSession, raise_on_failure=True)

    writer = found.writeStream.foreachBatch(make).option("checkpointLocation", checkpoint)
    query = (writer if continuous else writer.trigger(availableNow=True)).start()
    if not continuous:
        query.awaitTermination()
    return query
