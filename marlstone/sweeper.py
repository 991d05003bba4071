"""Removes expired rows from disk now and then, in a thread."""

from __future__ import annotations

from threading import Event, Thread

from .catalog import Catalog
from .errors import EngineError


MANY = 64  # segments: each small INSERT makes one


class Sweeper(Thread):
    """Rewrites the segments that hold expired rows, and tables of many segments, every so many seconds. Readers never see expired rows in any case."""

    def __init__(self, catalog: Catalog, every: float = 60.0):
        super().__init__(daemon=True)
        self.catalog, self.every, self.ended = catalog, every, Event()
        self.sweeps = 0

    def run(self) -> None:
        while not self.ended.wait(self.every):
            self.sweep()

    def sweep(self) -> None:
        for table in self.catalog.tables():
            try:
                self.catalog.sweep(table, MANY)
            except EngineError:  # dropped, or another process was first: the next sweep sees to it
                continue
        self.sweeps += 1

    def stop(self) -> None:
        self.ended.set()
        if self.is_alive():
            self.join()
