"""A bounded memo for values that many documents repeat."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Recent(dict):
    """Computes what it lacks, and forgets what went unused for a generation, so that it never holds more than limit.

    Indexing is a plain dict lookup for what is held, which lets map(memo.__getitem__, words) run in C.
    """

    def __init__(self, compute: Callable[[Any], Any], limit: int = 250_000):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit // 2, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def learn(self, keys: list, values: list) -> None:
        """Adds what was computed elsewhere for keys that are not held."""
        if len(self) + len(keys) >= self.limit:
            self.older = dict(self)
            self.clear()
        self.update(zip(keys, values, strict=True))
