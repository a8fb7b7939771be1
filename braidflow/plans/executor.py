"""Running a pipeline: routing of values, sharing, guards, freshness and failures.

Tables stay lazy from step to step, so a chain of DataFrame steps is one Catalyst plan. A
boundary makes a table real: a declared output (it is written), a guard (retry, fallback,
timeout: the action must fail inside it), or ``materialize="step"``. A step that several
nodes share runs once per run, and its table is persisted until the run ends; what is among
the results stays until ``Results.release``.
"""

from __future__ import annotations

import inspect
import os
import tempfile
import threading
import time
import traceback
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import singledispatch
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import wildcards
from ..operators.grouped import TableBlock
from ..sources import tables
from ..sources.files import find_matches, total_size
from . import display
from .nodes import Branch, Broadcast, Fallback, Force, ForEach, Node, NoWork, Parallel, Pipe, Pipeline, Reduce, Resourced, Retry, SameInput, Sequence, Shell, Sql, Step, Timeout, lift, steps, work_label
from .resources import Budget
from .results import PipelineError, Results, StepFailure, StepResult
from .state import Completed, StateTable, is_fresh, missing, step_hash
from .timing import Scope, Stopped, cancel_jobs

NOTHING = type("Nothing", (), {"__repr__": lambda self: "NOTHING"})()


class Cycle(ValueError):
    """A pipeline part that contains itself."""


@dataclass
class Context:
    """One run's mutable state."""

    spark: SparkSession | None
    jobs: int
    budget: Budget
    materialize: str = "boundary"
    spill_bytes: int | None = None
    spill_dir: str | None = None
    completed: Completed = field(default_factory=lambda: Completed(None))
    track_state: bool = False
    done: list[Step] = field(default_factory=list)
    memo: dict[int, Future] = field(default_factory=dict)
    shared: set[int] = field(default_factory=set)
    persisted: list[DataFrame] = field(default_factory=list)
    lock: threading.RLock = field(default_factory=threading.RLock)
    slots: threading.Semaphore | None = None
    local: threading.local = field(default_factory=threading.local)
    report_step: Callable[[StepResult], None] | None = None
    report_progress: Callable[[int, int], None] | None = None

    def inherited(self) -> dict[str, Any]:
        """What a thread hands on to the threads that it starts."""
        return dict(self.local.__dict__)

    @contextmanager
    def as_part(self, inherited: dict[str, Any]) -> Iterator[None]:
        """This new thread goes on where the one that started it was."""
        self.local.__dict__.update(inherited)
        if self.scope is None:
            yield
            return
        self.scope.enter()
        try:
            yield
        finally:
            self.scope.leave()

    @property
    def scope(self) -> Scope | None:
        return getattr(self.local, "scope", None)

    @property
    def own_budget(self) -> Budget:
        """What the innermost surrounding request was granted, else the run's budget."""
        return getattr(self.local, "budget", self.budget)

    @property
    def guarded(self) -> bool:
        return getattr(self.local, "guards", 0) > 0

    def within_guard(self, fn: Callable[[], Results]) -> Results:
        self.local.guards = getattr(self.local, "guards", 0) + 1
        try:
            return fn()
        finally:
            self.local.guards -= 1

    def make_real(self, df: DataFrame) -> DataFrame:
        """Run the table's plan now and keep its rows for whoever reads it next."""
        return self.counted(df)[0]

    def counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """``make_real``, with the number of rows."""
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        n = df.count()
        with self.lock:
            self.persisted.append(df)
        return df, n


# ---------------------------------------------------------------- leaf work


@singledispatch
def execute(work: Any, step: Step, ctx: Context, value: Any) -> Any:
    """The value of a step's work; register a work type to extend."""
    if not callable(work):
        raise InvalidWork(f"{step.name}: {type(work).__name__} is no step work")
    return work(*_arguments(work, step, value))


class InvalidWork(TypeError):
    """Work of a type that no executor takes."""


class MissingInput(FileNotFoundError):
    """An input of a step's work that isn't there when it runs."""


class ProcessFailed(RuntimeError):
    """A command with an exit code other than 0."""


def _arguments(fn: Callable, step: Step, value: Any) -> list:
    """The upstream value if there is one, else the declared inputs, as far as fn takes any."""
    given = list(step.inputs) if value is NOTHING else [_unspilled(value)]
    try:
        parameters = list(inspect.signature(fn).parameters.values())
    except (TypeError, ValueError):
        return given
    if any(p.kind == p.VAR_POSITIONAL for p in parameters):
        return given
    takes = [p for p in parameters if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    if value is NOTHING and len(takes) == 1 and len(given) > 1 and takes[0].default is takes[0].empty:
        return [given]
    needed = sum(p.default is p.empty for p in takes)
    return given[: max(needed, min(len(given), len(takes)))]


def _unspilled(value: Any) -> Any:
    """Plain values that were too large to keep, alone or in a list, as they were."""
    if isinstance(value, tables.SpilledValue):
        return tables.materialize(value)
    if isinstance(value, list) and any(isinstance(x, tables.SpilledValue) for x in value):
        return [_unspilled(x) for x in value]
    return value


@execute.register
def _(work: Sql, step: Step, ctx: Context, value: Any) -> DataFrame:
    spark = ctx.spark or SparkSession.active()
    text = work.text() if callable(work.text) else work.text
    inputs = list(step.inputs) if value is NOTHING else value if isinstance(value, (list, tuple)) else [value]
    names = {}
    for i, item in enumerate(inputs):
        names[f"input{i}"] = tables.materialize_table(item, spark)
    for i in range(len(inputs)):
        text = text.replace(f"{{{i}}}", f"{{input{i}}}")
    return spark.sql(text, args=work.args or {}, **names) if names else spark.sql(text, args=work.args or {})


@execute.register
def _(work: Shell, step: Step, ctx: Context, value: Any) -> Any:
    command = work.command() if callable(work.command) else work.command
    code, out, err = tables.capture(command, ctx.spill_bytes, ctx.spill_dir, ctx.scope)
    if code:
        raise ProcessFailed(f"exit code {code}", err)
    return out


def _run_leaf(step: Step, ctx: Context, forced: bool, value: Any) -> StepResult:
    began = time.monotonic()

    counted: dict[str, int] = {}

    def result(success: bool, value: Any, skipped: bool = False) -> StepResult:
        r = StepResult(step.name, success, 0.0 if skipped else time.monotonic() - began, value, step.inputs, step.outputs, skipped, step, counted.get("rows"), counted.get("bytes"))
        if ctx.report_step:
            ctx.report_step(r)
        return r

    def fail(kind: str, message: str, detail: str = "") -> StepResult:
        return result(False, StepFailure(kind, message, detail))

    try:
        if ctx.track_state and not forced and (step.inputs or step.outputs) and is_fresh(step, ctx.completed):
            return result(True, None, skipped=True)
        if lost := missing(step.inputs):
            return fail("missing_input", f"missing input: {', '.join(lost)}")
        ctx.local.forced = forced
        out = execute(step.work, step, ctx, value)
        if ctx.scope is not None:
            ctx.scope.check()
        if isinstance(out, DataFrame):
            if len(step.outputs) == 1:
                seen = Observation()
                tables.write_table(out.observe(seen, F.count(F.lit(1)).alias("rows")), step.outputs[0])
                counted |= {"rows": seen.get["rows"], "bytes": total_size(step.outputs[0])}
                out = tables.read_table(out.sparkSession, step.outputs[0])
            elif ctx.guarded or ctx.materialize == "step" or id(step) in ctx.shared:
                out, counted["rows"] = ctx.counted(out)
        elif ctx.spill_bytes is not None:
            out = tables.spilled_if_large(out, ctx.spill_bytes, ctx.spill_dir)
        if lost := missing(step.outputs):
            return fail("missing_output", f"missing output: {', '.join(lost)}")
    except ProcessFailed as e:
        return fail("process_failed", str(e.args[0]), str(e.args[1]))
    except InvalidWork as e:
        return fail("invalid_step_work", str(e))
    except MissingInput as e:
        return fail("missing_input", str(e))
    except Exception as e:
        return fail("exception", f"{type(e).__name__}: {e}"[:2000], traceback.format_exc()[:65536])
    if ctx.scope is not None:
        ctx.scope.check()
    with ctx.lock:
        ctx.done.append(step)
    return result(True, out)


# ---------------------------------------------------------------- nodes


@singledispatch
def run_node(node: Any, ctx: Context, forced: bool, value: Any) -> Results:
    """The results of a node; register a node type to extend."""
    raise TypeError(f"no way to run {type(node).__name__}")


@run_node.register
def _(node: Step, ctx: Context, forced: bool, value: Any) -> Results:
    if isinstance(node.work, Node):
        return run_node(node.work, ctx, forced, value)
    if value is not NOTHING:
        return Results([_slotted(node, ctx, forced, value)])
    with ctx.lock:
        future = ctx.memo.get(id(node))
        mine = future is None
        if mine:
            future = ctx.memo[id(node)] = Future()
    if mine:
        try:
            future.set_result(_slotted(node, ctx, forced, value))
        except Stopped:  # others may wait for the step outside of the time limit
            future.set_result(StepResult(node.name, False, 0.0, StepFailure("timed_out", "stopped by a time limit"), node.inputs, node.outputs, False, node))
            raise
        except BaseException as e:
            future.set_exception(e)
            raise
    return Results([future.result()])


def _slotted(node: Step, ctx: Context, forced: bool, value: Any) -> StepResult:
    """One pool of job slots for the whole run, taken only by steps while they run."""
    hints = getattr(ctx.local, "hints", (0, 0))
    with ctx.own_budget.admit(*hints):
        if ctx.slots is None:
            return _run_leaf(node, ctx, forced, value)
        with ctx.slots:
            return _run_leaf(node, ctx, forced, value)


def _value_of(results: Results) -> Any:
    return results[-1].value if results else NOTHING


@run_node.register
def _(node: Sequence, ctx: Context, forced: bool, value: Any) -> Results:
    out = Results()
    for part in node.nodes:
        found = run_node(part, ctx, forced, value)
        out.extend(found)
        if not found.success:
            break
        value = _value_of(found)
    return out


def _fan_out(parts: list[tuple[Node, Any]], ctx: Context, forced: bool) -> list[Results]:
    """Branches in threads, ``jobs`` of them at most; results in the branches' order.

    Under Spark's FAIR scheduling each thread's jobs have a pool of their own, so that no
    branch's jobs wait for all of another's.
    """
    ctx.completed.look_up(s for n, _ in parts for s in steps(n))
    if len(parts) <= 1 or ctx.jobs == 1:
        return [run_node(n, ctx, forced, v) for n, v in parts]
    inherited = ctx.inherited()
    out: list[Any] = [None] * len(parts)
    done: list[int] = []
    waiting = iter(range(len(parts)))
    fair = ctx.spark is not None and ctx.spark.sparkContext.getConf().get("spark.scheduler.mode", "FIFO").upper() == "FAIR"

    def one(i: int, own: dict[str, Any]) -> None:
        try:
            with ctx.as_part(own):
                out[i] = run_node(parts[i][0], ctx, forced, parts[i][1])
                with ctx.lock:
                    done.append(i)
                    if ctx.report_progress:
                        ctx.report_progress(len(done), len(parts))
        except BaseException as e:
            out[i] = e

    def some(k: int) -> None:
        own = inherited
        if fair:
            own = inherited | {"pool": f"{inherited.get('pool', 'branch')}-{k}"}
            ctx.spark.sparkContext.setLocalProperty("spark.scheduler.pool", own["pool"])
        while True:
            with ctx.lock:
                i = next(waiting, None)
            if i is None:
                return
            one(i, own)

    target = some
    if ctx.spark is not None:
        from pyspark import inheritable_thread_target

        target = inheritable_thread_target(ctx.spark)(some)
    threads = [threading.Thread(target=target, args=(k,), daemon=True) for k in range(min(len(parts), ctx.jobs or len(parts)))]
    for t in threads:
        t.start()
    for t in threads:
        while t.is_alive():  # a time limit can interrupt between two waits
            t.join(0.2 if ctx.scope is not None else None)
    for x in out:
        if isinstance(x, BaseException):
            raise x
    return out


@run_node.register
def _(node: Parallel, ctx: Context, forced: bool, value: Any) -> Results:
    return Results(r for rs in _fan_out([(n, NOTHING) for n in node.nodes], ctx, forced) for r in rs)


@run_node.register
def _(node: Fallback, ctx: Context, forced: bool, value: Any) -> Results:
    found = ctx.within_guard(lambda: run_node(node.primary, ctx, forced, value))
    return found if found.success else run_node(node.otherwise, ctx, forced, value)


@run_node.register
def _(node: Retry, ctx: Context, forced: bool, value: Any) -> Results:
    found = Results()
    for attempt in range(max(1, node.attempts)):
        if attempt:
            time.sleep(node.delay)
            with ctx.lock:
                for s in _inside(node.node):
                    ctx.memo.pop(id(s), None)
        found = ctx.within_guard(lambda: run_node(node.node, ctx, forced, value))
        if found.success:
            break
    return found


def _inside(node: Node) -> list[Step]:
    return steps(node)


@run_node.register
def _(node: Branch, ctx: Context, forced: bool, value: Any) -> Results:
    if node.keep and isinstance(value, DataFrame):
        value = ctx.make_real(value)
    chosen = node.condition() if value is NOTHING else node.condition(value)
    if not isinstance(chosen, bool):
        raise TypeError(f"a branch condition must give a bool, not {type(chosen).__name__}")
    return run_node(node.if_true if chosen else node.if_false, ctx, forced, value)


@run_node.register
def _(node: Timeout, ctx: Context, forced: bool, value: Any) -> Results:
    group, box = f"timeout-{uuid.uuid4().hex[:12]}", {}
    scope, inherited = Scope(ctx.scope), ctx.inherited()

    def work() -> None:
        try:
            with ctx.as_part(inherited | {"scope": scope}):
                if ctx.spark is not None:
                    ctx.spark.sparkContext.setJobGroup(group, "timed step", True)
                box["results"] = ctx.within_guard(lambda: run_node(node.node, ctx, forced, value))
        except BaseException as e:
            box["error"] = e

    target = work
    if ctx.spark is not None:
        from pyspark import inheritable_thread_target

        target = inheritable_thread_target(ctx.spark)(work)
    began = time.monotonic()
    thread = threading.Thread(target=target, daemon=True)
    thread.start()
    while thread.is_alive() and (left := node.seconds - (time.monotonic() - began)) > 0:
        thread.join(min(left, 0.2) if ctx.scope is not None else left)
    spent = time.monotonic() - began
    if thread.is_alive():
        scope.stop()
        if ctx.spark is not None:
            cancel_jobs(ctx.spark, group)
        return Results([StepResult("timeout", False, spent, StepFailure("timed_out", f"over {node.seconds} s"))])
    if "error" in box:
        return Results([StepResult("timeout", False, spent, StepFailure("inner_exception", f"{type(box['error']).__name__}: {box['error']}"))])
    return box["results"]


@run_node.register
def _(node: Force, ctx: Context, forced: bool, value: Any) -> Results:
    return run_node(node.node, ctx, True, value)


@run_node.register
def _(node: Reduce, ctx: Context, forced: bool, value: Any) -> Results:
    found = run_node(node.node, ctx, forced, value)
    began = time.monotonic()
    if not found.success:
        return Results([*found, StepResult(node.name, False, 0.0, "Reduce aborted: upstream failed")])
    try:
        out = node.fn([_read_back(r) for r in found])
        if isinstance(out, DataFrame) and (ctx.guarded or ctx.materialize == "step"):
            out = ctx.make_real(out)
    except Exception as e:
        return Results([*found, StepResult(node.name, False, time.monotonic() - began, f"Reduce error: {type(e).__name__}: {e}")])
    return Results([*found, StepResult(node.name, True, time.monotonic() - began, out)])


def _read_back(r: StepResult) -> Any:
    """A skipped step's value is read from its outputs again, never a marker text."""
    if r.skipped and r.outputs:
        found = [tables.FilePath(p) for p in r.outputs]
        return found[0] if len(found) == 1 else found
    return _unspilled(r.result)


def branches_of(node: ForEach, ctx: Context) -> list[tuple[Node, Any]] | StepFailure:
    """(branch, its input) of each item or matching path."""
    if isinstance(node.block, TableBlock):
        return _table_branch(node, ctx)
    if node.pattern is not None:
        names = wildcards(node.pattern)
        found = [[m[n] for n in names] for _, m in find_matches(node.pattern)]
        parts = [(_block(node, *captures), captures) for captures in found]
    else:
        items = [r[0] if len(r) == 1 else r for r in node.source.toLocalIterator()] if isinstance(node.source, DataFrame) else node.source
        parts = [(_block(node, item), item) for item in items]
    return parts or StepFailure("no_matches", f"nothing matches {node.pattern}" if node.pattern else "no items")


def _table_branch(node: ForEach, ctx: Context) -> list[tuple[Node, Any]] | StepFailure:
    """A table block's one step: of a table of items, or of all files of a pattern, by their
    wildcards unless the block says otherwise; one scan, whatever there are."""
    block, source = node.block, node.source
    if node.pattern is None:
        if not isinstance(source, DataFrame):
            raise TypeError("a table block needs a table of items or a pattern")
        return [(Step(lambda: block(source), "for_each"), NOTHING)]
    values = [m for _, m in find_matches(node.pattern)]
    if not values:
        return StepFailure("no_matches", f"nothing matches {node.pattern}")
    by_file = block if block.by else replace(block, by=tuple(wildcards(node.pattern)))
    return [(Step(lambda: by_file(tables.read_keyed(ctx.spark or SparkSession.active(), node.pattern, values)), "for_each"), NOTHING)]


def _block(node: ForEach, *arguments: Any) -> Node:
    made = node.block(*arguments)
    if made is node:
        raise Cycle("a for_each block returns its own node")
    if isinstance(made, (str, bytes, int, float)):
        raise TypeError(f"a for_each block must give a step or a node, not {type(made).__name__}")
    return lift(made)


def _no_branches(failure: StepFailure) -> Results:
    return Results([StepResult("for_each", False, 0.0, failure)])


@run_node.register
def _(node: ForEach, ctx: Context, forced: bool, value: Any) -> Results:
    parts = branches_of(node, ctx)
    if isinstance(parts, StepFailure):
        return _no_branches(parts)
    return Results(r for rs in _fan_out(parts, ctx, forced) for r in rs)


@run_node.register
def _(node: NoWork, ctx: Context, forced: bool, value: Any) -> Results:
    return Results()


@run_node.register
def _(node: Pipe, ctx: Context, forced: bool, value: Any) -> Results:
    left = run_node(node.left, ctx, forced, value)
    if not left.success:
        return left
    passed = left[-1:] if node.terminal_only and isinstance(node.left, Sequence) else left
    values = [r.value for r in passed]
    return Results([*left, *run_node(node.right, ctx, forced, values[0] if len(values) == 1 else values if values else NOTHING)])


@run_node.register
def _(node: SameInput, ctx: Context, forced: bool, value: Any) -> Results:
    left = run_node(node.left, ctx, forced, value)
    return Results([*left, *run_node(node.right, ctx, forced, value)]) if left.success else left


def _spread(node: Node, right: Node, ctx: Context) -> list[tuple[Node, Any]] | StepFailure:
    """The branches of a node, each followed by ``right``; broadcasting is associative."""
    if isinstance(node, Broadcast):
        inner = _spread(node.left, node.right, ctx)
        return inner if isinstance(inner, StepFailure) else [(Sequence.of(n, right), v) for n, v in inner]
    if isinstance(node, Step) and isinstance(node.work, Node):
        return _spread(node.work, right, ctx)
    if isinstance(node, ForEach):
        parts = branches_of(node, ctx)
        return parts if isinstance(parts, StepFailure) else [(Sequence.of(n, right), v) for n, v in parts]
    if isinstance(node, Parallel):
        return [(Sequence.of(n, right), NOTHING) for n in node.nodes]
    return [(Sequence.of(node, right), None)]


@run_node.register
def _(node: Broadcast, ctx: Context, forced: bool, value: Any) -> Results:
    parts = _spread(node.left, node.right, ctx)
    if isinstance(parts, StepFailure):
        return _no_branches(parts)
    parts = [(n, value if v is None else v) for n, v in parts]
    return Results(r for rs in _fan_out(parts, ctx, forced) for r in rs)


@run_node.register
def _(node: Resourced, ctx: Context, forced: bool, value: Any) -> Results:
    before = {k: ctx.local.__dict__[k] for k in ("hints", "budget") if k in ctx.local.__dict__}
    try:
        if isinstance(node.node, Step) and not isinstance(node.node.work, Node):  # it takes the budget when it runs, not its waiters
            ctx.local.hints = tuple(max(a, b) for a, b in zip(before.get("hints", (0, 0)), _most(node)))
            return run_node(node.node, ctx, forced, value)
        with ctx.own_budget.admit(*_most(node), least=1) as granted:
            ctx.local.hints, ctx.local.budget = (0, 0), granted
            return run_node(node.node, ctx, forced, value)
    except Exception as e:
        return Results([StepResult("resourced", False, 0.0, StepFailure("resource_exception", f"{type(e).__name__}: {e}"))])
    finally:
        for k in ("hints", "budget"):
            ctx.local.__dict__.pop(k, None)
        ctx.local.__dict__.update(before)


def _most(node: Node) -> tuple[int, int]:
    """The most memory and threads that a request in the tree asks for: the outermost one
    takes as much, since what is inside is served out of its grant."""
    parts = [_most(c) for c in node.children()]
    if isinstance(node, Resourced):
        parts.append((node.resources.memory_mb, node.resources.threads))
    return max((m for m, _ in parts), default=0), max((t for _, t in parts), default=0)


# ---------------------------------------------------------------- run


def default_jobs() -> int:
    """Steps at a time: as many as processors, 8 at most."""
    return min(os.cpu_count() or 1, 8)


def default_memory_mb() -> int:
    """Half of the machine's memory, in MB."""
    return int(os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / 2 / 1e6)


def _shared_steps(node: Node) -> set[int]:
    """Steps that stand more than once in the tree: their tables are worth keeping."""
    seen: dict[int, int] = {}

    def walk(n: Node) -> None:
        if isinstance(n, Step) and not isinstance(n.work, Node):
            seen[id(n)] = seen.get(id(n), 0) + 1
        for c in n.children():
            walk(c)

    walk(node)
    return {k for k, n in seen.items() if n > 1}


def check_cycles(node: Node, above: tuple[int, ...] = ()) -> None:
    if id(node) in above:
        raise Cycle(f"{type(node).__name__} contains itself")
    for child in node.children():
        check_cycles(child, (*above, id(node)))


def run(
    pipeline: Any, spark: SparkSession | None = None, *, verbose: bool = False, dry_run: bool = False, force: bool = False, jobs: int | None = None, threads: int | None = None, memory_mb: int | None = None,
    auto_spill: bool = True, spill_threshold: int = 10_000_000, spill_dir: str | None = None, state_dir: str | None = None, report: Callable[..., Any] | None = None, materialize: str = "boundary", raise_on_failure: bool = False, **rule_options: Any,
) -> Results:
    """Run a pipeline, a node, a rule, a chain of rules or a workflow.

    jobs: steps at a time over the whole run (0: no limit). threads, memory_mb: budgets for
    ``with_resources`` (0: no limit). state_dir: where completed steps are remembered;
    without it nothing is skipped but what file times show to be fresh. report(results,
    pipeline=name) is called before the state is saved; the state is saved even if it, or
    a branch condition, raises. A failed step doesn't raise; see ``raise_on_failure``.
    """
    from .rules import Rule, RuleChain, RuleValuePipe, Workflow, planned

    if isinstance(pipeline, (Rule, RuleChain, RuleValuePipe, Workflow)):
        pipeline = Pipeline(planned(pipeline, **rule_options), pipeline.name)
    elif isinstance(pipeline, list) and pipeline and all(isinstance(x, Rule) for x in pipeline):
        pipeline = Pipeline(planned(pipeline, **rule_options), "rules")
    elif not isinstance(pipeline, Pipeline):
        pipeline = Pipeline(lift(pipeline))
    check_cycles(pipeline.root)
    if dry_run:
        if verbose:
            display.print_dag(pipeline)
        out = Results()
        out.planned = steps(pipeline.root)
        return out
    if materialize not in ("boundary", "step"):
        raise ValueError("materialize is 'boundary' or 'step'")
    spark = spark or SparkSession.getActiveSession()
    jobs = default_jobs() if jobs is None else jobs
    budget = Budget(default_memory_mb() if memory_mb is None else memory_mb, (jobs or os.cpu_count() or 1) if threads is None else threads)
    state = StateTable(spark, state_dir) if state_dir and spark is not None else None
    folder = (spill_dir or tempfile.mkdtemp(prefix="braidflow-spill-")) if auto_spill else None
    ctx = Context(spark, jobs, budget, materialize, spill_threshold if auto_spill else None, folder, Completed(state), True, shared=_shared_steps(pipeline.root), slots=threading.Semaphore(jobs) if jobs else None)
    if verbose:
        ctx.report_step = lambda r: display.log_step(r)
        ctx.report_progress = lambda done, total: display.log_progress(done, total)
    results = Results()
    try:
        ctx.completed.look_up(steps(pipeline.root))
        results = run_node(pipeline.root, ctx, force, NOTHING)
        if report is not None:
            report(results, pipeline=pipeline.name)
    finally:
        if state:
            done = {step_hash(s): s for s in reversed(ctx.done)}
            known = state.completed(done)
            state.append([s for h, s in reversed(done.items()) if h not in known])
        kept = {id(r.result) for r in results}
        for df in ctx.persisted:
            if id(df) in kept:
                results.persisted.append(df)
            else:
                df.unpersist()
    if verbose:
        display.log(results.summary())
    if raise_on_failure and not results.success:
        raise PipelineError(results)
    return results


__all__ = ["NOTHING", "Context", "Cycle", "InvalidWork", "ProcessFailed", "execute", "run", "run_node", "work_label"]
