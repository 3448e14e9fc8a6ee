"""A bounded cache for Python workers."""

from __future__ import annotations


class Bounded(dict):
    """A dict of at most ``limit`` entries. What comes first stays, as frequent
    words come early; after ``8 * limit`` further keys it starts anew, so a
    change of language does not leave it useless."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.passed = limit, 0

    def put(self, key, value):
        if len(self) < self.limit:
            self[key] = value
            return
        self.passed += 1
        if self.passed > 8 * self.limit:
            self.passed = 0
            self.clear()
