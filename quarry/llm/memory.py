"""What a Python worker remembers between blocks and tasks, within bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import TypeVar

T = TypeVar("T")
_held: dict[str, object] = {}


def worker_state(name: str, make: Callable[[], T]) -> T:
    """One object per worker. Asking for another lets go of the one before, so operators that follow each other in a job do
    not add up."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def release_worker_state() -> None:
    """Let go of what this worker remembers for other operators, and give the freed heap back to the system.

    Operators that hold no memory of their own call it when their task starts: a reused Python worker may still hold an
    encoder's pieces from a stage before.
    """
    if _held:
        _held.clear()
        import ctypes
        import gc

        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:
            pass


class Memory:
    """Results by string in two generations: those used of late, and those used before that.

    Within a block all that is asked for is in ``young``. ``tidy`` after it forgets strings that are too long to keep, and the
    older generation once the younger one holds ``size``.
    """

    def __init__(self, size: int, longest: int):
        self.size, self.longest = size, longest
        self.young: dict = {}
        self.old: dict = {}
        self.passing: list[str] = []

    def missing(self, wanted: set[str]) -> set[str]:
        """What is not known. What is known from before counts as used."""
        unseen = wanted.difference(self.young)
        again = unseen.intersection(self.old)
        self.young.update((text, self.old[text]) for text in again)
        return unseen.difference(again)

    def learn(self, texts: Iterable[str], results: Iterable) -> None:
        fresh = dict(zip(texts, results))
        self.young.update(fresh)
        self.passing = [text for text in fresh if len(text) > self.longest]

    def tidy(self) -> None:
        for text in self.passing:
            self.young.pop(text, None)
        self.passing = []
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
