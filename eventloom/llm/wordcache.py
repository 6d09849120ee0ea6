"""A bounded cache for what is worked out once per distinct word."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class WordCache(dict):
    """word -> work(word). Of two generations of `most` words, the older one goes when the younger is full; words in `fixed` never go."""

    def __init__(self, work: Callable[[str], Any], most: int = 150_000, fixed: dict[str, Any] | None = None):
        super().__init__(fixed or {})
        self.work, self.most, self.fixed, self.old = work, most, fixed or {}, {}

    def __missing__(self, word: str) -> Any:
        found = self.old.get(word)
        if found is None:
            found = self.work(word)
        if len(word) > 64:  # long words are rare and seldom come again
            return found
        if len(self) - len(self.fixed) >= self.most:
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)
        self[word] = found
        return found
