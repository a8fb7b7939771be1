"""Soft budgets: a step waits until its memory and thread hints fit."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager


class Budget:
    """One weighted admission for memory and threads together.

    A request over the capacity is cut down to it and so runs alone. What is granted is a
    budget of its own, out of which everything inside the request is served: however many
    branches that has, together they never use more than the grant. Memory that a request
    doesn't name stays with the budget around it, which the requests inside ask in turn,
    after they have their threads: who holds memory waits for nothing, so nesting can't lock.
    A capacity of 0 means no limit.
    """

    def __init__(self, memory_mb: int, threads: int, outer: "Budget | None" = None) -> None:
        self.capacity = (memory_mb, threads)
        self.free = list(self.capacity)
        self.outer = outer  # whose memory it is, if not its own
        self.changed = threading.Condition()

    @contextmanager
    def admit(self, memory_mb: int, threads: int, least: int = 0) -> Iterator["Budget"]:
        """The granted budget, of at least ``least`` threads if they are limited."""
        own = (0 if self.outer is not None else memory_mb, max(threads, least))
        want = [min(a, c) if c else 0 for a, c in zip(own, self.capacity)]
        with self.changed:
            self.changed.wait_for(lambda: all(w <= f for w, f in zip(want, self.free)))
            self.free = [f - w for f, w in zip(self.free, want)]
        try:
            if not memory_mb:
                yield Budget(0, want[1], self.outer or self)
            elif self.outer is not None:
                with self.outer.admit(memory_mb, 0) as granted:
                    yield Budget(granted.capacity[0], want[1])
            else:
                yield Budget(*want)
        finally:
            with self.changed:
                self.free = [f + w for f, w in zip(self.free, want)]
                self.changed.notify_all()
