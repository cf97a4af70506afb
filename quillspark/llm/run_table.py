"""Tables from runs of text to their ids, of bounded size, for operators that encode every distinct run once.

A ``RunTables`` numbers runs as they are met and keeps the ids of all of them
in flat arrays, so a text is a row of run numbers and its ids are one gather.
Runs that were not met before are collected and learned together.  When a
generation has ``limit`` runs the next one begins: runs that are met again are
taken over from the generation before it and the rest is dropped with it, so
frequent runs are never learned twice and memory stays bounded.  What is in the
tables never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class _Numbers(dict):
    """run -> number; a run that is missing gets the next one and is noted, or -1 if it is not usable."""

    def __init__(self, kind: int, noted: list[tuple[int, str]], settled: list[int], usable: Callable[[str], bool] | None):
        self.kind, self.noted, self.settled, self.usable = kind, noted, settled, usable

    def __missing__(self, run: str) -> int:
        if self.usable is not None and not self.usable(run):
            return -1
        at = self[run] = self.settled[0] + len(self.noted)
        self.noted.append((self.kind, run))
        return at


class _Generation:
    def __init__(self, usable: list[Callable[[str], bool] | None]):
        self.noted: list[tuple[int, str]] = []
        self.settled = [0]
        self.tables = [_Numbers(k, self.noted, self.settled, u) for k, u in enumerate(usable)]
        self.starts, self.counts, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.int32)
        self.used = 0

    def add(self, counts: np.ndarray, ids: np.ndarray) -> None:
        first, n = self.settled[0], len(counts)
        self.starts, self.counts, self.ids = (_room(self.starts, first + n), _room(self.counts, first + n), _room(self.ids, self.used + len(ids)))
        self.counts[first : first + n] = counts
        self.starts[first : first + n] = self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + len(ids)] = ids
        self.settled[0] += n
        self.used += len(ids)

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.counts[rows]
        return self.ids[spread(self.starts[rows], counts)], counts


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts, dtype=np.int64)
    out = np.repeat(starts - (ends - counts), counts)
    out += np.arange(len(out))
    return out


class RunTables:
    """Tables that share their ids, one for each item of ``usable``.

    An item says which runs a table takes (None: all).  ``learn`` gets a list of
    (table, run) and gives the number of ids of each and all ids on end, as arrays.
    """

    def __init__(self, usable: list[Callable[[str], bool] | None], limit: int, learn: Callable[[list[tuple[int, str]]], tuple[np.ndarray, np.ndarray]]):
        self.usable, self.limit, self.learn = usable, limit, learn
        self.now, self.old = _Generation(usable), _Generation(usable)

    def begin(self) -> list[_Numbers]:
        """The tables for the next texts; numbers given before are void."""
        if self.now.settled[0] >= self.limit:
            self.now, self.old = _Generation(self.usable), self.now
        return self.now.tables

    def settle(self) -> None:
        """Learn the runs that were noted."""
        now, old = self.now, self.old
        if not now.noted:
            return
        new = [old.tables[kind].get(run, -1) for kind, run in now.noted]
        rows = np.array(new, dtype=np.int64)
        fresh = np.flatnonzero(rows < 0)
        counts, ids = self.learn([now.noted[k] for k in fresh.tolist()]) if len(fresh) else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        if len(fresh) < len(rows):
            held = np.flatnonzero(rows >= 0)
            old_ids, old_counts = old.gather(rows[held])
            order = np.argsort(np.concatenate([held, fresh]), kind="stable")
            every, starts = np.concatenate([old_counts, counts]), np.concatenate([old_ids, ids])
            begin = np.cumsum(every, dtype=np.int64) - every
            counts, ids = every[order], starts[spread(begin[order], every[order])]
        now.add(counts, ids)
        now.noted.clear()

    def known(self, kind: int, run: str) -> int:
        """The number of a run that is settled, or -1."""
        at = self.now.tables[kind].get(run, -1)
        return at if at < self.now.settled[0] else -1

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the runs ``rows`` on end, how many each has); settle first."""
        return self.now.gather(rows)
