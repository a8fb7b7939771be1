"""Incremental builds: which steps are up to date, by file times or by completed steps.

Completed steps are rows of a Parquet table, appended once per run.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import threading
import time
import types
from collections.abc import Container, Iterable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import exists, file_times
from .nodes import Shell, Sql, Step

#: Steps looked up by an IN list, which Parquet's filters take apart.
FEW_STEPS = 10
_BLOOM = {"parquet.bloom.filter.enabled#step_hash": "true"}
SCHEMA = "step_hash long, name string, inputs array<string>, outputs array<string>, completed_at double"


def _value(x: Any, above: tuple[int, ...] = ()) -> bytes:
    """A value as bytes that don't depend on the process: of functions their compiled body,
    defaults and closure, of containers their elements, of what has no such form its type."""
    if x is None or isinstance(x, (bool, int, float, complex, str, bytes)) or x is Ellipsis:
        return f"{type(x).__name__}:{x!r}".encode()
    if id(x) in above:
        return b"itself"
    inside = (*above, id(x))
    if isinstance(x, (set, frozenset)):
        return b"{" + b",".join(sorted(_value(v, inside) for v in x)) + b"}"
    if isinstance(x, (list, tuple)):
        return b"[" + b",".join(_value(v, inside) for v in x) + b"]"
    if isinstance(x, dict):
        return b"{" + b",".join(sorted(_value(k, inside) + b"=" + _value(v, inside) for k, v in x.items())) + b"}"
    if isinstance(x, types.CodeType):
        return b"\0".join([x.co_code, *(_value(c, inside) for c in x.co_consts), repr(x.co_names).encode()])
    if isinstance(x, functools.partial):
        return _value((x.func, x.args, x.keywords), inside)
    if isinstance(x, types.MethodType):
        return _value((x.__func__, x.__self__), inside)
    if isinstance(x, types.FunctionType):
        source = getattr(x, "__code_source__", None)
        if source is not None:
            return _value(source, inside)
        cells = []
        for c in x.__closure__ or ():
            try:
                cells.append(c.cell_contents)
            except ValueError:  # not set yet
                cells.append(None)
        return _value((x.__code__, x.__defaults__, x.__kwdefaults__, cells), inside)
    kind = x if isinstance(x, type) else type(x)
    named = f"{kind.__module__}.{kind.__qualname__}".encode()
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return named + _value([getattr(x, f.name) for f in dataclasses.fields(x)], inside)
    if isinstance(x, (types.ModuleType, types.BuiltinFunctionType)):
        return f"{named.decode()}:{x.__name__}".encode()
    return named


def work_id(work: Any) -> bytes:
    """Of text its text, of a function its compiled body with the defaults and the closure's
    values that it was made with: an edit, or another value, makes the step new."""
    if isinstance(work, Sql):
        return _value((work.text, work.args))
    return _value(work.command if isinstance(work, Shell) else work)


def step_hash(step: Step) -> int:
    """64 bits of name, work, inputs and outputs; the same in every process.

    A step keeps it from when it is first asked, before the step runs: what the work then
    does to a list that it holds doesn't make it another step.
    """
    if "_hash" in step.__dict__:
        return step.__dict__["_hash"]
    digest = hashlib.blake2b(digest_size=8)
    for part in (step.name.encode(), work_id(step.work), repr(step.inputs).encode(), repr(step.outputs).encode()):
        digest.update(len(part).to_bytes(8, "little") + part)
    found = int.from_bytes(digest.digest(), "little", signed=True)
    object.__setattr__(step, "_hash", found)
    return found


class StateTable:
    """Completed step hashes in a Parquet directory; a missing one is an empty state."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def completed(self, hashes: Iterable[int]) -> set[int]:
        """Which of some steps are completed: the state is scanned where it lies, and no more
        than those asked for comes back. A few are looked up by the files' Bloom filters."""
        asked = list(dict.fromkeys(hashes))
        if not asked:
            return set()
        known = self.table().select("step_hash")
        if len(asked) <= FEW_STEPS:
            found = known.where(F.col("step_hash").isin(asked))
        else:
            found = known.join(F.broadcast(self.spark.createDataFrame([(h,) for h in asked], "step_hash long")), "step_hash", "left_semi")
        return {r["step_hash"] for r in found.distinct().collect()}

    def pending(self, steps: DataFrame) -> DataFrame:
        """The rows of a table of steps (``step_hash`` and any other columns) that aren't
        completed; an anti-join on executors, of any number of steps."""
        return stale_steps(steps, self.table())

    def append(self, steps: list[Step]) -> None:
        if steps:
            rows = [(step_hash(s), s.name, list(s.inputs), list(s.outputs), time.time()) for s in steps]
            self.append_table(self.spark.createDataFrame(rows, SCHEMA).coalesce(1))

    def append_table(self, steps: DataFrame) -> None:
        """Mark the steps of a table (``step_hash``; name, inputs and outputs if there are any)
        as completed now."""
        given = {f.name: f for f in T.StructType.fromDDL(SCHEMA)}
        columns = [F.col(n) if n in steps.columns else (F.lit(time.time()) if n == "completed_at" else F.lit(None)).cast(f.dataType).alias(n) for n, f in given.items()]
        steps.select(*columns).write.options(**_BLOOM).mode("append").parquet(self.path)

    def compact(self) -> None:
        """Rewrite with one row per step, its last completion, in order of the hashes, so that
        a look-up skips most row groups."""
        from ..sources.tables import write_table

        newest = self.table().groupBy("step_hash").agg(*(F.max_by(c, "completed_at").alias(c) for c in ("name", "inputs", "outputs")), F.max("completed_at").alias("completed_at"))
        write_table(newest.orderBy("step_hash"), self.path, **_BLOOM)

    def clear(self) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Completed:
    """Membership in the state of the steps at hand, asked for in as few jobs as may be."""

    def __init__(self, state: StateTable | None) -> None:
        self.state = state
        self.known: dict[int, bool] = {}
        self.lock = threading.Lock()

    def look_up(self, steps: Iterable[Step]) -> None:
        """Ask at once for all steps that only the state can tell to be fresh."""
        if self.state is not None:
            hashed = [(step_hash(s), s) for s in steps]
            self._ask([h for h, s in hashed if bool(s.inputs) != bool(s.outputs)])

    def _ask(self, hashes: list[int]) -> None:
        with self.lock:
            new = [h for h in hashes if h not in self.known]
            if new:
                found = self.state.completed(new) if self.state is not None else set()
                self.known |= {h: h in found for h in new}

    def __contains__(self, h: int) -> bool:
        if h not in self.known:
            self._ask([h])
        return self.known[h]


def is_fresh(step: Step, completed: Container[int]) -> bool:
    """Missing inputs or outputs: stale. With both, every input must be strictly older than
    the oldest output. Otherwise the completed steps decide."""
    ins = [file_times(p) for p in step.inputs]
    outs = [file_times(p) for p in step.outputs]
    if None in ins or None in outs:
        return False
    if ins and outs:
        return max(t.newest for t in ins) < min(t.oldest for t in outs)
    return step_hash(step) in completed


def missing(paths: tuple[str, ...]) -> list[str]:
    return [p for p in paths if not exists(p)]


def fresh_steps(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """The same rule over tables of (step, modified): steps whose every input is older than
    every output. Two aggregates and an equi-join on the step."""
    newest = inputs.groupBy("step").agg(F.max("modified").alias("newest_input"))
    oldest = outputs.groupBy("step").agg(F.min("modified").alias("oldest_output"))
    return newest.join(oldest, "step").where("newest_input < oldest_output")


def stale_steps(steps: DataFrame, completed: DataFrame) -> DataFrame:
    """Steps that no run has completed."""
    return steps.join(completed.select("step_hash").distinct(), "step_hash", "left_anti")


def merged(state: DataFrame, new: DataFrame) -> DataFrame:
    return state.select("step_hash").union(new.select("step_hash")).distinct()
