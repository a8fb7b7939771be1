"""The algebra's operators where all parts are tables: one plan, no driver control."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables


def union_all(branches: Mapping[str, DataFrame], tag: str = "branch") -> DataFrame:
    """The rows of all branches, each with its branch's name: what ``pipe`` hands on."""
    out: DataFrame | None = None
    for name, df in branches.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no branches")
    return out


def per_branch(branches: Mapping[str, DataFrame], fn: Callable[[DataFrame], DataFrame], tag: str = "branch") -> DataFrame:
    """``broadcast``: the function of each branch, tagged."""
    return union_all({name: fn(df) for name, df in branches.items()}, tag)


#: So many rules are folded into one expression; more are broadcast, and over the second
#: number (of rules, which are plan metadata) it is an error.
FOLDED_RULES = 200
MOST_RULES = 100_000
#: Kinds of patterns (which of their segments are literal) that rules may be of.
MOST_KINDS = 10_000


def first_match(targets: DataFrame, target: str, rules: DataFrame, regex: str, position: str) -> DataFrame:
    """Each target with the first rule, by position, whose expression matches it.

    A few rules become one ``CASE WHEN ... RLIKE`` of literals: a projection of the targets,
    without a join. An expression has nothing to join by, so more are tried one after another
    against each distinct target, as a broadcast of checked size; of many path patterns use
    ``first_rule``, which has an index. Targets that no rule matches go; of rules of one
    position the lesser expression comes first.
    """
    found = rules.orderBy(F.col(f"`{position}`"), F.col(f"`{regex}`")).limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    own = [F.col(f"`{c}`") for c in targets.columns]
    if len(found) <= FOLDED_RULES:
        chosen: Column | None = None
        for r in found:
            rule = F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in rules.schema))
            hit = F.col(f"`{target}`").rlike(r[regex])
            chosen = F.when(hit, rule) if chosen is None else chosen.when(hit, rule)
        if chosen is None:
            return targets.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rules.schema)).limit(0)
        return targets.select("*", chosen.alias("__rule")).where("__rule IS NOT NULL").select(*own, "__rule.*")
    tried = rules.select(F.struct(*(F.col(f"`{c}`") for c in rules.columns)).alias("__rule"), F.col(f"`{regex}`").alias("__regex"), F.col(f"`{position}`").alias("__position"))
    asked = targets.select(F.col(f"`{target}`").alias("__t")).where("__t IS NOT NULL").distinct()
    met = asked.join(F.broadcast(tried), F.rlike("__t", "__regex"))
    first = met.groupBy("__t").agg(F.min_by("__rule", F.struct("__position", "__regex")).alias("__rule"))
    return targets.join(first, F.col(f"`{target}`") == F.col("__t")).select(*own, "__rule.*")


def first_rule(targets: DataFrame, target: str, rules: DataFrame, pattern: str, position: str) -> DataFrame:
    """Each target with the first rule, by position, whose path pattern matches it; any number
    of rules and targets.

    Rules are indexed by their kind (number of segments, and which are literal) and their
    literal segments. A target is asked for once per kind of its number of segments: an
    equi-join on the segments that the kind has as literals, and only what meets there is
    matched by the expression. Of rules of one position the lesser pattern comes first.
    Targets that no rule matches go. Patterns all of whose segments have wildcards share one
    key per number of segments, and of the last one's ending.
    """
    spark = targets.sparkSession
    segments = F.split("__p", "/")
    wild = lambda s: s.rlike(r"\{\w+\}")
    escaped = F.regexp_replace("__p", r"([.^$*+?()\[\]{}|\\])", r"\\$1")
    #: The last segment's ending, where no wildcard reaches into it.
    ending = F.regexp_extract("__p", r"\.([^./{}]+)$", 1)
    index = rules.select(F.struct(*(F.col(f"`{c}`") for c in rules.columns)).alias("__rule"), F.col(f"`{pattern}`").alias("__p"), F.col(f"`{position}`").alias("__position")).where("__p IS NOT NULL").select(
        "__rule", "__p", "__position", F.size(segments).alias("__n"), F.array_join(F.transform(segments, lambda s: F.when(wild(s), "1").otherwise("0")), "").alias("__mask"), (ending != "").alias("__ended"),
        F.concat_ws("/", F.filter(segments, lambda s: ~wild(s)), F.when(ending != "", ending)).alias("__key"), F.concat(F.lit("^"), F.regexp_replace(escaped, r"\\\{\w+\\\}", "([^/]+)"), F.lit("$")).alias("__regex"),
    )
    kinds = index.select("__n", "__mask", "__ended").distinct().limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"patterns of over {MOST_KINDS} kinds")
    asked = targets.select(F.col(f"`{target}`").alias("__t")).where("__t IS NOT NULL").distinct()
    parts = F.split("__t", "/")
    known = F.broadcast(spark.createDataFrame(kinds, "__n int, __mask string, __ended boolean"))
    asked = asked.join(known, F.size(parts) == F.col("__n")).select(
        "__t", "__n", "__mask", "__ended",
        F.concat_ws("/", F.filter(parts, lambda s, i: F.substr(F.col("__mask"), i + 1, F.lit(1)) == "0"), F.when(F.col("__ended"), F.regexp_extract("__t", r"\.([^./{}]+)$", 1))).alias("__key"),
    )
    met = asked.join(index, ["__n", "__mask", "__ended", "__key"]).where(F.rlike("__t", "__regex"))
    first = met.groupBy("__t").agg(F.min_by("__rule", F.struct("__position", "__p")).alias("__rule"))
    return targets.join(first, F.col(f"`{target}`") == F.col("__t")).select(*(F.col(f"`{c}`") for c in targets.columns), "__rule.*")


class LineageCycle(ValueError):
    """Edges that lead back to where they come from."""


#: Edges (plan metadata) that the driver follows by itself.
DRIVER_EDGES = 100_000


def lineage(edges: DataFrame, target: str, child: str = "output", parent: str = "input", depth: int = 100) -> DataFrame:
    """path and depth (the longest way from the target) of everything that a target needs.

    Level by level, of each level the distinct paths: work grows with paths times levels,
    never with the number of ways between them. Up to DRIVER_EDGES edges are followed on
    the driver, more by a join per level, each a checkpoint. More than ``depth`` levels, or a
    cycle, are an error; the cycle's paths are named.
    """
    spark = edges.sparkSession
    ways = edges.select(F.col(child).cast("string").alias("o"), F.col(parent).cast("string").alias("i")).where("o IS NOT NULL AND i IS NOT NULL")
    few = ways.limit(DRIVER_EDGES + 1).collect()
    if len(few) <= DRIVER_EDGES:
        needs: dict[str, set[str]] = {}
        for o, i in few:
            needs.setdefault(o, set()).add(i)
        now, deepest = {target}, {}
        for k in range(depth + 1):
            deepest |= dict.fromkeys(now, k)
            now = {i for o in now for i in needs.get(o, ())}
            if not now:
                return spark.createDataFrame(sorted(deepest.items()), "path string, depth int")
        raise _endless(ways.distinct(), depth)
    tables.checkpoint_dir(spark)
    ways = ways.distinct().checkpoint()
    level = spark.range(1).select(F.lit(target).alias("path"))
    out = level.select("path", F.lit(0).alias("depth"))
    for k in range(1, depth + 2):
        level = level.join(ways, F.col("path") == F.col("o")).select(F.col("i").alias("path")).distinct().checkpoint()
        if level.isEmpty():
            return out.groupBy("path").agg(F.max("depth").alias("depth"))
        out = out.unionAll(level.select("path", F.lit(k).alias("depth")))
    raise _endless(ways, depth)


def _endless(ways: DataFrame, depth: int) -> ValueError:
    """The paths on cycles, or between two, by stripping edges that lead nowhere or come
    from nowhere; without any left, the lineage is only long."""
    tables.checkpoint_dir(ways.sparkSession)
    left, n = ways, ways.count()
    while n:
        leads, comes = left.select(F.col("o").alias("i")).distinct(), left.select(F.col("i").alias("o")).distinct()
        less = left.join(leads, "i", "left_semi").join(comes, "o", "left_semi").select("o", "i").checkpoint()
        m = less.count()
        left = less
        if m == n:
            break
        n = m
    names = [r["o"] for r in left.select("o").distinct().orderBy("o").limit(10).collect()] if n else []
    return LineageCycle(f"a cycle over {', '.join(names)}") if names else ValueError(f"over {depth} levels")


def chunks(df: DataFrame, jobs: int, partition: list[str], order: list[str], name: str = "chunk") -> DataFrame:
    """The chunk of at most ``jobs`` rows that each row is in, within its partition."""
    n = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn(name, F.floor((n - 1) / jobs).cast("long"))


def results_summary(results: DataFrame) -> DataFrame:
    """Totals of a results table."""
    return results.agg(F.count_if("success").alias("succeeded"), F.count("*").alias("total"), F.bool_and("success").alias("all_ok"), F.bool_or(~F.col("success")).alias("any_failed"), F.round(F.sum("duration"), 4).alias("seconds"))


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the last row in the order, with all its columns; one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*keys, "__last.*")


def existing(wanted: DataFrame, there: DataFrame, on: str) -> DataFrame:
    """The wanted rows whose path (or key) is there."""
    return wanted.join(there.select(on), on, "left_semi")


def lacking(wanted: DataFrame, there: DataFrame, on: str) -> DataFrame:
    """The wanted rows whose path (or key) isn't there."""
    return wanted.join(there.select(on), on, "left_anti")
