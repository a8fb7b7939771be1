"""Exact places of rows in a global order, and files cut by them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables

#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
_WITHIN = 33


def with_ordinals(df: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """The rows with their place (from 0) in the given order; rows that tie in any order.

    A range shuffle sorts; the sorted rows are written, so that places are dealt once. The
    rows of each partition are counted, and a partition's places begin at the sum of those
    before it: no window over all rows, and the driver holds a number per partition.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    spark = df.sparkSession
    path = f"{tables.scratch_dir(spark, '-ordinals')}/{uuid.uuid4().hex[:12]}"
    df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    part = F.shiftright("__at", _WITHIN)
    first, offsets = 0, []
    for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((r["part"], first))
        first += r["n"]
    starts = spark.createDataFrame(offsets, "__part long, __first long")
    placed = rows.join(F.broadcast(starts), part == F.col("__part"))
    return placed.select(*df.columns, (F.col("__first") + F.col("__at").bitwiseAND((1 << _WITHIN) - 1)).alias(name))


def split_files(df: DataFrame, path: str, rows: int, *order: str | Column) -> int:
    """As ``split -l``: text files of exactly so many rows, but for the last; their number.

    Rows go in the given order (of all columns, if none is). Names sort as the rows do.
    """
    placed = with_ordinals(df, *(order or df.columns), name="__ordinal")
    total = placed.agg(F.max("__ordinal")).first()[0]
    n_files = 0 if total is None else total // rows + 1
    tasks = max(1, min(n_files, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    each = -(-n_files // tasks) or 1
    # A task has the rows of whole files, from a file's first row on: its cuts are the files'.
    part = F.floor(F.col("__ordinal") / (rows * each)).cast("int")
    dealt = placed.withColumn("__part", part).repartitionById(tasks, F.col("__part")).sortWithinPartitions("__ordinal")
    dealt.select(*df.columns).write.mode("overwrite").option("maxRecordsPerFile", rows).text(path)
    return n_files
