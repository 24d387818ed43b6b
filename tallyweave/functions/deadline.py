"""Calls with a deadline: a child process works them off and is replaced when one overruns, fails hard or dies."""

from __future__ import annotations

import contextlib
import multiprocessing
from collections.abc import Callable
from multiprocessing.connection import Connection

_context = multiprocessing.get_context("fork")  # the child has f as it is, whatever it closes over


def _serve(f: Callable, calls: Connection) -> None:
    while True:
        try:
            arguments = calls.recv()
        except EOFError:
            return
        try:
            calls.send((True, f(*arguments)))
        except Exception as error:  # noqa: BLE001  f is a user's; what it raises goes to the parent as text
            calls.send((False, f"{type(error).__name__}: {error}"))


class Failed(Exception):
    """A call raised, overran its deadline, or ended its process."""


class Supervised:
    """f with a deadline for each call; one child at a time, started with the first call."""

    def __init__(self, f: Callable, seconds: float) -> None:
        self.f, self.seconds = f, seconds
        self.child, self.calls, self.started = None, None, 0

    def __enter__(self) -> Supervised:
        return self

    def __exit__(self, *error: object) -> None:
        self.stop()

    def _start(self) -> None:
        self.calls, theirs = _context.Pipe()
        self.child = _context.Process(target=_serve, args=(self.f, theirs), daemon=True)
        self.child.start()
        theirs.close()
        self.started += 1

    def stop(self) -> None:
        if self.child is not None:
            self.calls.close()
            self.child.kill()
            self.child.join()
            self.child.close()
            self.child = None

    def __call__(self, *arguments: object) -> object:
        if self.child is None:
            self._start()
        answer = None
        with contextlib.suppress(OSError, EOFError):
            self.calls.send(arguments)
            if self.calls.poll(self.seconds):
                answer = self.calls.recv()
        if answer is None:
            self.stop()
            raise Failed("no answer in time")
        good, value = answer
        if not good:
            raise Failed(value)
        return value
