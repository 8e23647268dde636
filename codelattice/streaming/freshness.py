"""Answers while an index is being refreshed, told apart by the version that is published.

A refresh is a task of a pool with one worker: whoever asks while one is under way waits for that one. What
can be answered follows from the published version alone, so a process that has just started knows as much
as one that runs for days.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, wait
from typing import NamedTuple

#: Seconds to wait for a refresh where an older version can answer, and where there is none yet.
PATIENCE, FIRST_PATIENCE = 1.5, 5.0


class Published(NamedTuple):
    """A complete version of the index, and the time (seconds since 1970) of what it shows."""

    version: str
    at: float


class Seen(NamedTuple):
    """What a question can be answered from (None: nothing yet), and a remark if it may be out of date."""

    index: Published | None
    remark: str


class Freshness:
    """refresh() publishes a new version; published() tells the current one, or None."""

    def __init__(self, refresh: Callable[[], object], published: Callable[[], Published | None], patience: float = PATIENCE, first_patience: float = FIRST_PATIENCE):
        self._refresh, self._published = refresh, published
        self.patience, self.first_patience = patience, first_patience
        self._pool = ThreadPoolExecutor(1, thread_name_prefix="refresh")
        self._guard = threading.Lock()
        self._task: Future | None = None

    def asked(self) -> Future:
        """The refresh that is under way, or else a new one."""
        with self._guard:
            if self._task is None or self._task.done():
                self._task = self._pool.submit(self._refresh)
            return self._task

    def look(self) -> Seen:
        """Ask for a refresh, wait for it as long as patience lasts, and say what there is then."""
        task = self.asked()
        wait([task], self.first_patience if self._published() is None else self.patience)
        index = self._published()
        if not task.done():
            return Seen(index, "the first version of the index is not complete yet" if index is None else f"a refresh is under way; this is the state of {_age(index)}")
        fault = task.exception()
        if fault is None:
            return Seen(index, "")
        why = f"the index could not be refreshed ({type(fault).__name__}: {fault})"
        return Seen(index, why if index is None else f"{why}; this is the state of {_age(index)}")


def _age(index: Published) -> str:
    return f"{max(0, time.time() - index.at):.0f} s ago"
