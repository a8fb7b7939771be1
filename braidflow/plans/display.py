"""Text views: the node tree, steps as they end, previews."""

from __future__ import annotations

import sys
import threading
from functools import singledispatch
from typing import Any, TextIO

from .nodes import Branch, ForEach, Node, Pipeline, Reduce, Resourced, Retry, Step, Timeout, work_label

_lock = threading.Lock()
_COLOURS = {"node": "\x1b[36m", "step": "\x1b[32m", "off": "\x1b[0m"}


@singledispatch
def label(node: Any) -> str:
    """A node's line in the tree; register a node type to extend."""
    return type(node).__name__


@label.register
def _(node: Step) -> str:
    paths = f"  [{', '.join(node.inputs)} -> {', '.join(node.outputs)}]" if node.inputs or node.outputs else ""
    return f"{node.name}: {work_label(node.work)[:80]}{paths}"


@label.register
def _(node: Retry) -> str:
    return f"Retry x{node.attempts}" + (f", {node.delay} s apart" if node.delay else "")


@label.register
def _(node: Timeout) -> str:
    return f"Timeout {node.seconds} s"


@label.register
def _(node: Reduce) -> str:
    return f"Reduce {node.name}"


@label.register
def _(node: ForEach) -> str:
    return f"ForEach {node.pattern}" if node.pattern else "ForEach over a table" if hasattr(node.source, "schema") else f"ForEach over {len(node.source)} items"


@label.register
def _(node: Branch) -> str:
    return f"Branch on {getattr(node.condition, '__name__', 'a condition')}"


@label.register
def _(node: Resourced) -> str:
    return f"Resources {node.resources.memory_mb} MB, {node.resources.threads} threads"


def dag(node: Node | Pipeline, color: bool = False) -> str:
    """The tree as text."""
    lines: list[str] = []
    if isinstance(node, Pipeline):
        lines.append(node.name)
        node = node.root

    def walk(n: Node, head: str, tail: str) -> None:
        text = label(n)
        if color:
            text = _COLOURS["step" if isinstance(n, Step) else "node"] + text + _COLOURS["off"]
        lines.append(head + text)
        children = n.children()
        for i, c in enumerate(children):
            last = i == len(children) - 1
            walk(c, tail + ("└─ " if last else "├─ "), tail + ("   " if last else "│  "))

    walk(node, "", "")
    return "\n".join(lines)


def print_dag(node: Node | Pipeline, color: bool = False, file: TextIO | None = None) -> None:
    log(dag(node, color), file)


def log(text: str, file: TextIO | None = None) -> None:
    with _lock:
        print(text, file=file or sys.stdout, flush=True)


def log_step(r: Any) -> None:
    log(f"{'skip' if r.skipped else 'ok' if r.success else 'FAIL'} {r.step} ({r.duration:.2f} s)" + (f": {r.failure}" if r.failure else ""))


def log_progress(done: int, total: int) -> None:
    log(f"  {done}/{total} branches done" + (f", {total - done} left" if done < total else ""))
