"""Calls with a deadline and a bound on memory, in a child process of the worker that makes them."""

from __future__ import annotations

import multiprocessing
import resource
from collections.abc import Callable

#: Seconds and bytes that one call may take.
SECONDS, BYTES = 60.0, 2 << 30


def _serve(pipe, call: Callable, bytes_: int) -> None:
    try:
        with open("/proc/self/statm") as held:
            now = int(held.read().split()[0]) * resource.getpagesize()
        resource.setrlimit(resource.RLIMIT_AS, (now + bytes_, now + bytes_))
    except (OSError, ValueError):  # no such bound on this system
        pass
    while True:
        try:
            calls = pipe.recv()
        except EOFError:
            return
        for arguments in calls:
            try:
                answer = (True, call(*arguments))
            except MemoryError:
                answer = (False, "out of memory")
            except Exception as error:
                answer = (False, f"{type(error).__name__}: {error}")
            pipe.send(answer)


class Limited:
    """``call`` in a child that is killed, and started anew, where an answer takes longer than ``seconds``.

    ``run`` returns the answer, or raises ``LimitReached`` or ``CallFailed``;
    ``run_each`` does many calls, each under limits of its own.
    Use as a context manager: the child ends with it.
    """

    def __init__(self, call: Callable, seconds: float = SECONDS, bytes_: int = BYTES):
        self.call, self.seconds, self.bytes, self.child = call, seconds, bytes_, None

    def __enter__(self) -> Limited:
        return self

    def __exit__(self, *_) -> None:
        self._end()

    def _end(self) -> None:
        if self.child is not None:
            self.pipe.close()
            self.child.kill()
            self.child.join()
            self.child = None

    def _start(self) -> None:
        context = multiprocessing.get_context("fork")
        self.pipe, other = context.Pipe()
        self.child = context.Process(target=_serve, args=(other, self.call, self.bytes), daemon=False)
        self.child.start()
        other.close()

    def run(self, *arguments):
        (answer,) = self.run_each([arguments])
        if isinstance(answer, (LimitReached, CallFailed)):
            raise answer
        return answer

    def run_each(self, calls: list[tuple]) -> list:
        """For each call, in order, its answer or the ``LimitReached`` or ``CallFailed`` in its place.

        The child is sent the calls at once and answers one by one, so neither waits for the other at each of them.
        """
        out: list = []
        while len(out) < len(calls):
            if self.child is None:
                self._start()
            try:
                self.pipe.send(calls[len(out) :])
                while len(out) < len(calls):
                    if not self.pipe.poll(self.seconds):
                        self._end()
                        out.append(LimitReached(f"stopped after {self.seconds:g} s"))
                        break
                    good, answer = self.pipe.recv()
                    out.append(answer if good else CallFailed(answer))
            except (EOFError, BrokenPipeError, ConnectionResetError):  # the child died
                self._end()
                out.append(CallFailed("the process that did it ended"))
        return out


class LimitReached(Exception):
    pass


class CallFailed(Exception):
    pass
