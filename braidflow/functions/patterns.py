"""Path patterns with ``{wildcard}`` parts, at plan time and as columns.

A wildcard stands for one or more characters other than ``/``. Plan-time functions work on
strings; those ending in ``_column`` build expressions that Catalyst evaluates.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WILDCARD = re.compile(r"\{(\w+)\}")
_SPECIAL = re.compile(r"\{(input|output)(?:\[(\d+)\])?\}")


def wildcards(*patterns: str) -> list[str]:
    """Names in order of first appearance."""
    return list(dict.fromkeys(name for p in patterns for name in WILDCARD.findall(p)))


def has_wildcards(*patterns: str) -> bool:
    return any(WILDCARD.search(p) for p in patterns)


def _literal(text: str) -> str:
    return re.sub(r"[.^$*+?()\[\]{}|\\]", r"\\\g<0>", text)


def to_regex(pattern: str) -> tuple[str, list[str]]:
    """A whole-path regular expression, portable to Java and RE2, and its groups' names."""
    parts, names, at = [], [], 0
    for m in WILDCARD.finditer(pattern):
        parts += [_literal(pattern[at : m.start()]), "([^/]+)"]
        names.append(m[1])
        at = m.end()
    return "^" + "".join(parts) + _literal(pattern[at:]) + "$", names


def match(pattern: str, path: str) -> dict[str, str] | None:
    """The wildcards' values, or None; of a repeated name the last value counts."""
    regex, names = _compiled(pattern)
    if regex is None:
        return {} if path == pattern else None
    m = regex.match(path)
    return dict(zip(names, m.groups())) if m else None


@functools.lru_cache(maxsize=1 << 16)
def _compiled(pattern: str) -> tuple[re.Pattern | None, list[str]]:
    """Of a pattern without wildcards no expression: it is the path."""
    regex, names = to_regex(pattern)
    return (re.compile(regex) if names else None), names


def substitute(pattern: str, values: Mapping[str, object]) -> str:
    """Fill wildcards; ``{{`` and ``}}`` are literal braces; a missing name is an error."""

    def fill(m: re.Match) -> str:
        if m[0] in ("{{", "}}"):
            return m[0][0]
        if m[1] not in values:
            raise ValueError(f"no value for wildcard {{{m[1]}}} in {pattern!r}")
        return str(values[m[1]])

    return re.sub(r"\{\{|\}\}|\{(\w+)\}", fill, pattern)


def fill_special(template: str, inputs: Sequence[str], outputs: Sequence[str]) -> str:
    """``{input}``, ``{output}`` (joined by spaces) and their 1-based elements."""

    def fill(m: re.Match) -> str:
        paths = inputs if m[1] == "input" else outputs
        if m[2] is None:
            return " ".join(paths)
        if not 1 <= int(m[2]) <= len(paths):
            raise ValueError(f"{m[0]} is out of range in {template!r}")
        return paths[int(m[2]) - 1]

    return _SPECIAL.sub(fill, template)


def expand(templates: str | Iterable[str], **values: Iterable[object]) -> list[str]:
    """Templates filled with all combinations: templates outermost, then wildcards by first
    appearance, the last varying fastest. Unused names are ignored."""
    many = [templates] if isinstance(templates, str) else list(templates)
    if not values:
        return many
    names = wildcards(*many)
    if missing := [n for n in names if n not in values]:
        raise ValueError(f"no values for {missing}")
    lists = {n: [values[n]] if isinstance(values[n], str) else list(values[n]) for n in names}
    out = []
    for template in many:
        own = [n for n in names if n in WILDCARD.findall(template)]
        for combination in itertools.product(*(lists[n] for n in own)):
            out.append(substitute(template, dict(zip(own, combination))))
    return out


def literal_root(pattern: str) -> str:
    """The directory before the first wildcard, ``.`` if there is none."""
    m = WILDCARD.search(pattern)
    head = pattern[: m.start()] if m else pattern
    cut = head.rfind("/")
    return head[:cut] if cut > 0 else "/" if cut == 0 else "."


def to_glob(pattern: str) -> str:
    """A Hadoop glob that covers the pattern; the regular expression decides."""
    return WILDCARD.sub("*", pattern)


# ---------------------------------------------------------------- as columns


def match_column(path: Column, pattern: str) -> Column:
    """map<string,string> of the wildcards, null where the path doesn't match."""
    regex, names = to_regex(pattern)
    last = {n: i for i, n in enumerate(names, 1)}
    pairs = [x for n, i in last.items() for x in (F.lit(n), F.regexp_extract(path, regex, i))]
    return F.when(path.rlike(regex), F.create_map(*pairs))


def substitute_column(pattern: str, values: Mapping[str, Column]) -> Column:
    parts, at = [], 0
    for m in WILDCARD.finditer(pattern):
        if m[1] not in values:
            raise ValueError(f"no value for wildcard {{{m[1]}}} in {pattern!r}")
        parts += [F.lit(pattern[at : m.start()]), values[m[1]].cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))


def fill_special_column(template: str, inputs: Column, outputs: Column) -> Column:
    """``fill_special`` over array columns."""
    parts, at = [], 0
    for m in _SPECIAL.finditer(template):
        paths = inputs if m[1] == "input" else outputs
        parts += [F.lit(template[at : m.start()]), F.array_join(paths, " ") if m[2] is None else F.element_at(paths, int(m[2]))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def wildcards_column(pattern: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(pattern, F.lit(r"\{(\w+)\}"), F.lit(1)))


def expand_table(spark: SparkSession, template: str, **values: DataFrame) -> DataFrame:
    """``expand`` over single-column tables: a column per wildcard and ``target``.

    The product itself is what is asked for, so the sides are cross-joined.
    """
    names = wildcards(template)
    if missing := [n for n in names if n not in values]:
        raise ValueError(f"no values for {missing}")
    out: DataFrame | None = None
    for name in names:
        side = values[name].toDF(name)
        out = side if out is None else out.crossJoin(side)
    if out is None:
        return spark.range(1).select(F.lit(template).alias("target"))
    return out.withColumn("target", substitute_column(template, {n: F.col(n) for n in names}))
