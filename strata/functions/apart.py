"""Calls in a process of their own, which is replaced now and then.

Every identifier that ``ast`` reads is interned for as long as its process lives.
A worker that reads long files, or many, would keep all their names.
"""

from __future__ import annotations

import gc
import multiprocessing
from collections.abc import Callable

#: Characters of text that a process reads before another takes its place.
MOST = 1 << 22


def _serve(pipe, other) -> None:
    other.close()  # so that the end of the caller ends this process
    gc.disable()
    while True:
        try:
            function, args = pipe.recv()
        except EOFError:
            return
        try:
            answer = True, function(*args)
        except Exception as problem:  # noqa: BLE001  raised again by the caller
            answer = False, problem
        pipe.send(answer)
        del answer


class Apart:
    """Functions of a module, called in the process; results are pickled."""

    def __init__(self, most: int = MOST):
        self._most, self._left, self._process, self._pipe = most, 0, None, None

    def __call__(self, function: Callable, text: str, *args):
        if self._process is None:
            context = multiprocessing.get_context("fork")
            self._pipe, other = context.Pipe()
            self._process, self._left = context.Process(target=_serve, args=(other, self._pipe), daemon=True), self._most
            self._process.start()
            other.close()
        self._pipe.send((function, (text, *args)))
        fine, value = self._pipe.recv()
        self._left -= len(text)
        if self._left <= 0:
            self.close()
        if not fine:
            raise value
        return value

    def close(self) -> None:
        if self._process is not None:
            self._pipe.close()
            self._process.join()
            self._process = None

    def __enter__(self) -> Apart:
        return self

    def __exit__(self, *_) -> None:
        self.close()
