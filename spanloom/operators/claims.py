"""Stretches of a text that are taken, apart and in order, found by bisection."""

from __future__ import annotations

from bisect import bisect_left


class Claims:
    """Stretches of a text, apart and in order."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)  # the stretches before k begin before `end`
        return k == 0 or self.ends[k - 1] <= start

    def add(self, start: int, end: int) -> None:
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)

    def take(self, start: int, end: int) -> bool:
        """Adds a stretch that is not empty if it is free."""
        if start >= end or not self.free(start, end):
            return False
        self.add(start, end)
        return True
