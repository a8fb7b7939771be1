"""What pipelines do inside their steps: text lines, thresholds, summaries, as DataFrames.

Each takes and gives DataFrames, so that they chain in one plan. ``value`` is the line
column of ``spark.read.text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold(df: DataFrame, **least: float) -> DataFrame:
    """Rows whose columns, as numbers, are above a bound; what is no number counts as 0."""
    for name, bound in least.items():
        df = df.where(F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)) > bound)
    return df


def at_most(df: DataFrame, **most: float) -> DataFrame:
    for name, bound in most.items():
        df = df.where(F.col(name) <= bound)
    return df


def field_above(df: DataFrame, field: int, bound: float, separator: str = "\t", column: str = "value") -> DataFrame:
    """Lines whose 1-based field is above a bound, as in ``awk '$5 > 30'``."""
    return df.where(F.coalesce(F.get(F.split(column, separator), F.lit(field - 1)).try_cast("double"), F.lit(0.0)) > bound)


def sorted_lines(df: DataFrame, descending: bool = False, column: str = "value") -> DataFrame:
    return df.orderBy(F.desc(column) if descending else F.asc(column))


def unique_lines(df: DataFrame, column: str = "value") -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def line_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("lines"))


def byte_count(df: DataFrame, column: str = "value") -> DataFrame:
    """As ``wc -c``: bytes of the lines and of their ends."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column) + 1), F.lit(0)).cast("long").alias("bytes"))


def concat(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def head(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first rows in a given order: one top-n, never a full sort."""
    return df.orderBy(*order).limit(n)


def ascii_upper(column: str | Column) -> Column:
    """As ``tr a-z A-Z``."""
    return F.translate(F.col(column) if isinstance(column, str) else column, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def mean_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.round(F.avg(column), 6).alias("mean"), F.max(column).alias("max"))


#: Values that ``stripped_join`` puts into one text at most.
MOST_JOINED = 1_000_000


def stripped_join(df: DataFrame, column: str, separator: str = ",", distinct: bool = False) -> DataFrame:
    """The column's stripped values in order as one text, repeats and all unless ``distinct``.

    That is one row, so over MOST_JOINED values are an error, found before any are gathered.
    """
    values = df.select(F.trim(F.col(column)).alias("v")).where("v IS NOT NULL")
    values = values.distinct() if distinct else values
    if values.limit(MOST_JOINED + 1).count() > MOST_JOINED:
        raise ValueError(f"over {MOST_JOINED} values of {column}")
    return values.agg(F.array_join(F.array_sort(F.collect_list("v")), separator).alias("joined"))


def prefixed(column: str | Column, prefix: str) -> Column:
    """Stripped text behind a prefix, as in ``"got_" + strip(x)``."""
    return F.concat(F.lit(prefix), F.trim(F.col(column) if isinstance(column, str) else column))
