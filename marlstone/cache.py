"""Least-recently-used cache of results."""

from __future__ import annotations

from collections import OrderedDict
from threading import Lock
from typing import Any


class ResultCache:
    """Results by statement and by the versions of the tables it reads, so a write makes them unreachable. Large results aren't kept."""

    def __init__(self, entries: int = 1024, max_rows: int = 10_000):
        self.entries, self.max_rows = entries, max_rows
        self.kept: OrderedDict[Any, Any] = OrderedDict()
        self.lock = Lock()
        self.hits = 0

    def get(self, key: Any) -> Any | None:
        with self.lock:
            if key in self.kept:
                self.kept.move_to_end(key)
                self.hits += 1
                return self.kept[key]
            return None

    def put(self, key: Any, value: Any) -> None:
        with self.lock:
            self.kept[key] = value
            self.kept.move_to_end(key)
            while len(self.kept) > self.entries:
                self.kept.popitem(last=False)

    def clear(self) -> None:
        with self.lock:
            self.kept.clear()
