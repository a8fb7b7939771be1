"""What a run gives back: a result per executed step, also as a DataFrame."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType(), False), T.StructField("step", T.StringType(), False), T.StructField("success", T.BooleanType(), False), T.StructField("duration", T.DoubleType(), False),
        T.StructField("inputs", T.ArrayType(T.StringType()), False), T.StructField("outputs", T.ArrayType(T.StringType()), False), T.StructField("skipped", T.BooleanType(), False),
        T.StructField("failure", T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "message", "detail")])), T.StructField("result_preview", T.StringType()),
        T.StructField("rows", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("done", T.IntegerType(), False), T.StructField("total", T.IntegerType(), False),
    ]
)


@dataclass(frozen=True)
class StepFailure:
    """kind: missing_input, missing_output, process_failed, exception, invalid_step_work,
    timed_out, inner_exception, no_matches, resource_exception or aborted."""

    kind: str
    message: str
    detail: str = ""

    def __str__(self) -> str:
        return f"{self.kind}: {self.message}"


@dataclass(frozen=True)
class StepResult:
    step: str
    success: bool
    duration: float
    result: Any = None
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    skipped: bool = False
    source: Any = field(default=None, repr=False, compare=False)
    #: Of a table that the step has written or computed: its rows, counted as it was made, and
    #: the bytes of its files.
    rows: int | None = None
    bytes: int | None = None
    ended: float = field(default_factory=time.monotonic, repr=False, compare=False)

    @property
    def failure(self) -> StepFailure | None:
        return self.result if isinstance(self.result, StepFailure) else None

    def __str__(self) -> str:
        state = "skipped" if self.skipped else "ok" if self.success else "FAILED"
        lines = [f"{state} {self.step} ({self.duration:.2f} s)"]
        lines += [f"  {word} {', '.join(paths)}" for word, paths in (("from", self.inputs), ("to", self.outputs)) if paths]
        return "\n".join(lines + ([f"  {preview(self.result)}"] if self.result is not None else []))

    @property
    def value(self) -> Any:
        """What the next step gets: the declared outputs if there are any, else the result."""
        return list(self.outputs) if self.outputs else self.result


def preview(value: Any, limit: int = 200) -> str:
    if isinstance(value, DataFrame):
        text = f"DataFrame[{', '.join(f'{n}: {t}' for n, t in value.dtypes)}]"
    else:
        text = str(value).replace("\n", "\\n")
    return text if len(text) <= limit else text[: limit - 1] + "…"


class Results(list):
    """The results in order of branches, with totals and a table form.

    As a context manager, or by ``release``, it lets go of the tables that the run has
    persisted and that are among the results.
    """

    def __init__(self, *args: Any) -> None:
        super().__init__(*args)
        self.persisted: list[DataFrame] = []
        #: Of a dry run: the steps that a run would execute.
        self.planned: list[Any] = []

    def __enter__(self) -> "Results":
        return self

    def __exit__(self, *exc: Any) -> None:
        self.release()

    def release(self) -> None:
        while self.persisted:
            self.persisted.pop().unpersist()

    @property
    def success(self) -> bool:
        return all(r.success for r in self)

    @property
    def last(self) -> Any:
        """The last result's table or value."""
        return self[-1].result if self else None

    def __str__(self) -> str:
        return "\n".join([self.summary(), *map(str, self)])

    def failures(self) -> list[StepResult]:
        return [r for r in self if not r.success]

    def to_df(self, spark: SparkSession) -> DataFrame:
        """A row per result; ``done``: how many had ended with it, of ``total``."""
        ended = sorted(range(len(self)), key=lambda i: (self[i].ended, i))
        done = {i: k for k, i in enumerate(ended, 1)}
        rows = [(i, r.step, r.success, float(r.duration), list(r.inputs), list(r.outputs), r.skipped, None if r.failure is None else (r.failure.kind, r.failure.message, r.failure.detail), None if r.failure else preview(r.result), r.rows, r.bytes, done[i], len(self)) for i, r in enumerate(self)]
        return spark.createDataFrame(rows, SCHEMA)

    def plan_df(self, spark: SparkSession) -> DataFrame:
        """Of a dry run: ordinal, step, inputs, outputs and work of what a run would execute,
        as far as it is known before."""
        from .nodes import work_label

        rows = [(i, s.name, list(s.inputs), list(s.outputs), work_label(s.work)) for i, s in enumerate(self.planned)]
        return spark.createDataFrame(rows, "ordinal int, step string, inputs array<string>, outputs array<string>, work string")

    def summary(self) -> str:
        made = [r for r in self if r.rows is not None]
        counted = f", {sum(r.rows for r in made)} rows in {len(made)} tables" if made else ""
        return f"{sum(r.success for r in self)}/{len(self)} steps succeeded in {sum(r.duration for r in self):.2f} s{counted}"


class PipelineError(RuntimeError):
    def __init__(self, results: Results) -> None:
        super().__init__("; ".join(f"{r.step}: {r.failure or r.result}" for r in results.failures()))
        self.results = results
