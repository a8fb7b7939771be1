"""The operator algebra: an immutable tree of nodes; building runs nothing.

==================  ==========================================================
``a >> b``          sequence: b gets a's last value
``a & b``           parallel: independent branches, results in branch order
``a | b``           fallback: b's results instead of a's if any of a's failed
``a ** n``          retry, up to n attempts
``a.pipe(b)``       b gets the values of all of a's results
``a.same_input(b)`` both get the input that a gets
``a.broadcast(b)``  b once per branch of a
==================  ==========================================================

Callables, SQL text (``sql``) and shell commands (``shell``) become steps by themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

_names = itertools.count(1)


@dataclass(frozen=True)
class Sql:
    """Query text, or a function that gives it when the step runs; ``{0}``, ``{1}`` … are
    the step's input tables."""

    text: str | Callable[[], str]
    args: dict[str, Any] | None = None


@dataclass(frozen=True)
class Shell:
    """A command line (through ``sh``), an argument list, or a function that gives either."""

    command: str | list[str] | Callable[[], str | list[str]]


class Node:
    """A part of a pipeline."""

    def __rshift__(self, other: Any) -> "Sequence":
        return Sequence.of(self, lift(other))

    def __rrshift__(self, other: Any) -> "Sequence":
        return Sequence.of(lift(other), self)

    def __and__(self, other: Any) -> "Parallel":
        return Parallel.of(self, lift(other))

    def __rand__(self, other: Any) -> "Parallel":
        return Parallel.of(lift(other), self)

    def __or__(self, other: Any) -> "Fallback":
        return fallback(self, lift(other))

    def __ror__(self, other: Any) -> "Fallback":
        return fallback(lift(other), self)

    def __pow__(self, attempts: int) -> "Retry":
        return Retry(self, attempts)

    def pipe(self, other: Any, terminal_only: bool = False) -> "Pipe":
        return Pipe(self, lift(other), terminal_only)

    def same_input(self, other: Any) -> "SameInput":
        return SameInput(self, lift(other))

    def broadcast(self, other: Any) -> "Node":
        return Broadcast(self, lift(other))

    def children(self) -> tuple["Node", ...]:
        return ()

    def run(self, spark: Any = None, **options: Any) -> Any:
        from .executor import run

        return run(self, spark, **options)


@dataclass(frozen=True, eq=False)
class Step(Node):
    """A leaf: work with declared inputs and outputs (paths)."""

    work: Any
    name: str = ""
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()

    def children(self) -> tuple[Node, ...]:
        return (self.work,) if isinstance(self.work, Node) else ()


def _many(paths: str | Iterable[str] | None) -> tuple[str, ...]:
    return () if paths is None else (paths,) if isinstance(paths, str) else tuple(map(str, paths))


def work_label(work: Any) -> str:
    if isinstance(work, Sql):
        return work.text if isinstance(work.text, str) else "sql(…)"
    if isinstance(work, Shell):
        c = work.command
        return c if isinstance(c, str) else " ".join(c[:3]) + (" …" if len(c) > 3 else "") if isinstance(c, list) else "shell(…)"
    return getattr(work, "__name__", type(work).__name__)


def step(work: Any = None, *, name: str | None = None, inputs: Any = None, outputs: Any = None) -> Any:
    """A step of any work, or a decorator. Paths with wildcards make a rule instead."""
    if work is None:
        return lambda w: step(w, name=name, inputs=inputs, outputs=outputs)
    ins, outs = _many(inputs), _many(outputs)
    from ..functions.patterns import has_wildcards

    if has_wildcards(*ins, *outs):
        from .rules import Rule

        return Rule(name or work_label(work), ins, outs, work)
    label = name or work_label(work)
    return Step(work, f"step_{next(_names)}" if label in ("<lambda>", "") else label, ins, outs)


def sql(text: str | Callable[[], str], name: str | None = None, **args: Any) -> Step:
    return step(Sql(text, args or None), name=name or f"sql_{next(_names)}")


def shell(command: str | list[str] | Callable[[], Any], name: str | None = None, inputs: Any = None, outputs: Any = None) -> Any:
    return step(Shell(command), name=name or f"shell_{next(_names)}", inputs=inputs, outputs=outputs)


def shell_pipe(*commands: str) -> Step:
    """Commands joined by one operating-system pipe; the last one's output is the value."""
    return shell(" | ".join(commands))


def lift(x: Any) -> Node:
    """Nodes stay; callables, SQL and shell work, and DataFrames become steps."""
    if isinstance(x, Node):
        return x
    if isinstance(x, (Sql, Shell)) or callable(x):
        return step(x)
    if hasattr(x, "toDF") and hasattr(x, "schema"):
        return Step(lambda: x, f"table_{next(_names)}")
    raise TypeError(f"no step from {type(x).__name__}")


@dataclass(frozen=True, eq=False)
class Sequence(Node):
    nodes: tuple[Node, ...]

    @classmethod
    def of(cls, *nodes: Node) -> "Sequence":
        return cls(tuple(x for n in nodes for x in (n.nodes if isinstance(n, cls) else (n,))))

    def children(self) -> tuple[Node, ...]:
        return self.nodes


@dataclass(frozen=True, eq=False)
class Parallel(Node):
    nodes: tuple[Node, ...]

    @classmethod
    def of(cls, *nodes: Node) -> "Parallel":
        return cls(tuple(x for n in nodes for x in (n.nodes if isinstance(n, cls) else (n,))))

    def children(self) -> tuple[Node, ...]:
        return self.nodes


@dataclass(frozen=True, eq=False)
class Fallback(Node):
    primary: Node
    otherwise: Node

    def children(self) -> tuple[Node, ...]:
        return (self.primary, self.otherwise)


def fallback(a: Node, b: Node) -> Fallback:
    """``(a | b) | c`` is ``a | (b | c)``."""
    return Fallback(a.primary, fallback(a.otherwise, b)) if isinstance(a, Fallback) else Fallback(a, b)


@dataclass(frozen=True, eq=False)
class Retry(Node):
    node: Node
    attempts: int = 3
    delay: float = 0.0

    def children(self) -> tuple[Node, ...]:
        return (self.node,)


@dataclass(frozen=True, eq=False)
class Branch(Node):
    """``condition()`` or ``condition(value)`` picks an arm; it must give a bool.

    A table stays lazy: a condition that looks at its first rows reads no more of it. With
    ``keep`` it is computed and persisted once, for the condition and the arm.
    """

    condition: Callable[..., bool]
    if_true: Node
    if_false: Node
    keep: bool = False

    def children(self) -> tuple[Node, ...]:
        return (self.if_true, self.if_false)


def branch(condition: Callable[..., bool], if_true: Any, if_false: Any, keep: bool = False) -> Branch:
    return Branch(condition, lift(if_true), lift(if_false), keep)


@dataclass(frozen=True, eq=False)
class Timeout(Node):
    node: Node
    seconds: float

    def children(self) -> tuple[Node, ...]:
        return (self.node,)


@dataclass(frozen=True, eq=False)
class Force(Node):
    node: Node

    def children(self) -> tuple[Node, ...]:
        return (self.node,)


@dataclass(frozen=True, eq=False)
class Reduce(Node):
    """``fn`` of the list of all of the node's result values."""

    fn: Callable[[list], Any]
    node: Node
    name: str = "reduce"

    def children(self) -> tuple[Node, ...]:
        return (self.node,)


@dataclass(frozen=True, eq=False)
class ForEach(Node):
    """A branch per item, or per path that matches a pattern, found when the node runs."""

    source: Any
    block: Callable[..., Any]

    @property
    def pattern(self) -> str | None:
        return self.source if isinstance(self.source, str) else None


def for_each(source: Any, block: Callable[..., Any] | None = None) -> Any:
    """``block(item)``, or ``block(*captures)`` for a pattern; usable as a decorator."""
    if block is None:
        return lambda b: for_each(source, b)
    if isinstance(source, str):
        from ..functions.patterns import has_wildcards

        if not has_wildcards(source):
            raise ValueError(f"{source!r} has no wildcard")
        return ForEach(source, block)
    if hasattr(source, "collect") and hasattr(source, "schema"):
        return ForEach(source, block)  # a small table of items: rows, read when the node runs
    return ForEach(list(source), block)


@dataclass(frozen=True, eq=False)
class NoWork(Node):
    """Nothing to do: no results."""


@dataclass(frozen=True, eq=False)
class Pipe(Node):
    left: Node
    right: Node
    terminal_only: bool = False

    def children(self) -> tuple[Node, ...]:
        return (self.left, self.right)


@dataclass(frozen=True, eq=False)
class SameInput(Node):
    left: Node
    right: Node

    def children(self) -> tuple[Node, ...]:
        return (self.left, self.right)


@dataclass(frozen=True, eq=False)
class Broadcast(Node):
    left: Node
    right: Node

    def children(self) -> tuple[Node, ...]:
        return (self.left, self.right)


@dataclass(frozen=True)
class Resources:
    memory_mb: int = 0
    threads: int = 1


@dataclass(frozen=True, eq=False)
class Resourced(Node):
    node: Node
    resources: Resources

    def children(self) -> tuple[Node, ...]:
        return (self.node,)


def with_resources(node: Any, memory_mb: int = 0, threads: int = 1) -> Resourced:
    return Resourced(lift(node), Resources(memory_mb, threads))


@dataclass(frozen=True, eq=False)
class Pipeline:
    root: Node
    name: str = "pipeline"

    def run(self, spark: Any = None, **options: Any) -> Any:
        from .executor import run

        return run(self, spark, **options)


def steps(node: Node | Pipeline) -> list[Step]:
    """The distinct leaf steps; what a ``ForEach`` will make isn't known yet."""
    found: dict[int, Step] = {}

    def walk(n: Node) -> None:
        if isinstance(n, Step) and not isinstance(n.work, Node):
            found.setdefault(id(n), n)
        for child in n.children():
            walk(child)

    walk(node.root if isinstance(node, Pipeline) else node)
    return list(found.values())


def count_steps(node: Node | Pipeline) -> int:
    """Distinct steps that a run can execute: of a branch its larger arm, a reduce one more."""

    def count(n: Node, seen: set[int]) -> int:
        if isinstance(n, Branch):
            arms = [(count(arm, own := set(seen)), own) for arm in n.children()]
            most, own = max(arms, key=lambda a: a[0])
            seen |= own
            return most
        if isinstance(n, Step) and not isinstance(n.work, Node):
            new = id(n) not in seen
            seen.add(id(n))
            return int(new)
        return sum(count(c, seen) for c in n.children()) + isinstance(n, Reduce)

    return count(node.root if isinstance(node, Pipeline) else node, set())


