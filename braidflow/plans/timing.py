"""What a time limit ends: Spark jobs, commands, and the Python code of the branch's threads."""

from __future__ import annotations

import ctypes
import os
import signal
import subprocess
import threading
from typing import Any


class Stopped(BaseException):
    """Raised in the threads of a branch whose time is over."""


class Scope:
    """The threads and commands that run under one time limit."""

    def __init__(self, outer: "Scope | None" = None) -> None:
        self.outer, self.over = outer, False
        self.lock = threading.RLock()
        self.threads: set[threading.Thread] = set()
        self.commands: set[subprocess.Popen] = set()

    @property
    def stopped(self) -> bool:
        return self.over or self.outer is not None and self.outer.stopped

    def check(self) -> None:
        if self.stopped:
            raise Stopped

    def enter(self) -> None:
        """This thread works for the scope from now on."""
        with self.lock:
            self.check()
            self.threads.add(threading.current_thread())
        if self.outer is not None:
            self.outer.enter()

    def leave(self) -> None:
        with self.lock:
            self.threads.discard(threading.current_thread())
        if self.outer is not None:
            self.outer.leave()

    def started(self, command: subprocess.Popen) -> None:
        with self.lock:
            self.commands.add(command)
            if self.stopped:
                _kill(command)
        if self.outer is not None:
            self.outer.started(command)

    def ended(self, command: subprocess.Popen) -> None:
        with self.lock:
            self.commands.discard(command)
        if self.outer is not None:
            self.outer.ended(command)

    def stop(self) -> None:
        """End it all: nothing of the scope starts, ends or is recorded from now on.

        A thread is interrupted at its next Python instruction; a call out of Python (a
        sleep, say) returns first.
        """
        with self.lock:
            self.over = True
            for command in self.commands:
                _kill(command)
            for thread in self.threads:
                if thread.is_alive():
                    ctypes.pythonapi.PyThreadState_SetAsyncExc(ctypes.c_ulong(thread.ident), ctypes.py_object(Stopped))


def _kill(command: subprocess.Popen) -> None:
    """The command with all the processes that it started."""
    try:
        os.killpg(command.pid, signal.SIGKILL)
    except ProcessLookupError:
        pass


def cancel_jobs(spark: Any, group: str) -> None:
    """Cancel a group's Spark jobs, and those that it would start from now on."""
    spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(group)
