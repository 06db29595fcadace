"""A bounded table of results for keys met lately."""

from __future__ import annotations

from collections.abc import Callable


class Recent(dict):
    """``table[key]`` is ``make(key)``, kept while the key is in use.

    Two generations of at most ``most`` keys each: a full one becomes the older, and a
    key found there moves up.  Keys longer than ``longest`` are never kept.
    """

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest
        self.older: dict = {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found
