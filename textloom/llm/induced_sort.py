"""Suffix sorting with common prefixes by induced sorting, over arrays that live on disk.

The input is a file of symbols: bytes + 1, pieces ended by 0. Suffixes are sorted by their first `depth` symbols at
least, and each comes with the length of its common prefix with the one before it, up to CAP and never across a 0.

1. Suffixes are typed S (smaller than the one after them) or L. The leftmost S of each run (LMS) start substrings that
   are named in order by sorting tuples of packed symbols; ties are sorted on by their next symbols.
2. The reduced string of names is ranked by doubling until `depth` symbols are covered; the ranks of each round stay on
   disk and give the common prefixes of neighbours: whole names first, then the symbols where the first names that differ start.
3. L suffixes are induced from the sorted LMS suffixes in one pass by ascending first symbol, S suffixes from the L ones in
   one by descending symbol. Tuples (place, common prefix) wait in a monotone priority queue: a first-in first-out spool
   for each first symbol, kept on disk beyond a budget. What one run of equal first symbols induces is pushed at once;
   the common prefix of two induced neighbours is one more than the least one between their inducers, which a table of
   range minima gives for all pairs of the run.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

CAP = 200
SYMBOLS = 257
_NONE = -1


class Spool:
    """Tuples in first-in first-out order; in memory up to a budget that all spools of a queue share, then in a file."""

    def __init__(self, queue: Queue, name: str):
        self.queue, self.name, self.held, self.file = queue, name, [], None

    def push(self, place: np.ndarray, common: np.ndarray) -> None:
        if len(place):
            self.held.append((place, common))
            self.queue.grown(self, place.nbytes + common.nbytes)

    def spill(self) -> None:
        if self.file is None:
            self.file = [open(os.path.join(self.queue.where, f"{self.name}.{k}"), "w+b") for k in "pc"]
        for place, common in self.held:
            place.tofile(self.file[0])
            common.tofile(self.file[1])
        self.held = []

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        """All tuples that were pushed since the last call."""
        parts, self.held = self.held, []
        self.queue.bytes -= sum(p.nbytes + c.nbytes for p, c in parts)
        if self.file is not None:
            for f in self.file:
                f.seek(0)
            parts = [(np.fromfile(self.file[0], self.queue.kind), np.fromfile(self.file[1], np.uint8)), *parts]
            for f in self.file:
                f.close()
                os.unlink(f.name)
            self.file = None
        if not parts:
            return np.zeros(0, self.queue.kind), np.zeros(0, np.uint8)
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])


class Queue:
    """The monotone priority queue: a spool for each first symbol."""

    def __init__(self, where: str, name: str, kind: type, budget: int):
        self.where, self.kind, self.budget, self.bytes = where, kind, budget, 0
        self.spools = [Spool(self, f"{name}{c}") for c in range(SYMBOLS)]

    def grown(self, spool: Spool, size: int) -> None:
        self.bytes += size
        if self.bytes > self.budget:
            for s in self.spools:
                if s.held:
                    s.spill()
            self.bytes = 0


def range_minima(values: np.ndarray) -> list[np.ndarray]:
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def least(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The minimum of values[first..last] for each pair."""
    size = last - first + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(first), np.uint8)
    for k in np.unique(level):
        sel = level == k
        out[sel] = np.minimum(table[k][first[sel]], table[k][last[sel] - (1 << int(k)) + 1])
    return out


class SuffixSorter:
    def __init__(self, symbols: np.ndarray, where: str, depth: int = 100, budget: int = 256 << 20):
        self.t, self.where, self.depth, self.budget = symbols, where, depth, budget
        self.kind = np.int32 if len(symbols) < 2**31 - 2 else np.int64

    def _disk(self, name: str, values: np.ndarray) -> np.ndarray:
        path = os.path.join(self.where, name)
        values.tofile(path)
        return np.memmap(path, values.dtype, "r", shape=values.shape) if len(values) else values

    def types(self) -> np.ndarray:
        """Whether each suffix is of type S."""
        t = self.t
        n = len(t)
        s = np.zeros(n, bool)
        s[-1] = True
        step = 1 << 22
        last = True
        for end in range(n - 1, 0, -step):
            start = max(0, end - step)
            a, b = t[start:end], t[start + 1 : end + 1]
            sign = np.where(a < b, 1, np.where(a > b, 2, 0)).astype(np.int8)
            at = np.where(sign > 0, np.arange(end - start), end - start)
            nxt = np.minimum.accumulate(at[::-1])[::-1]
            s[start:end] = np.where(nxt < end - start, sign[np.minimum(nxt, end - start - 1)] == 1, last)
            last = bool(s[start])
        return s

    def names(self, lms: np.ndarray) -> np.ndarray:
        """The rank of each LMS substring among the distinct ones."""
        t, m, offset = self.t, len(lms), 0
        size = np.append(np.diff(lms) + 1, 1)
        rank = np.zeros(m, np.int64)
        active = np.arange(m)
        while len(active):
            word = np.zeros(len(active), np.uint64)
            for k in range(7):
                inside = offset + k < size[active]
                value = np.where(inside, t[np.minimum(lms[active] + offset + k, len(t) - 1)], 511)
                word = word << np.uint64(9) | value.astype(np.uint64)
            by = np.lexsort((word, rank[active])) if offset else np.argsort(word, kind="stable")
            r, w = rank[active][by], word[by]
            new = np.concatenate(([True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])))
            head = np.concatenate(([True], r[1:] != r[:-1]))
            first = np.flatnonzero(new)
            base = np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
            group = r + (np.repeat(first, np.diff(np.append(first, len(by)))) - base)
            rank[active[by]] = group
            tied = np.repeat(np.diff(np.append(first, len(by))) > 1, np.diff(np.append(first, len(by)))) & (size[active[by]] >= offset + 7)
            active, offset = np.sort(active[by][tied]), offset + 7
        order = np.argsort(rank, kind="stable")
        r = rank[order]
        new = np.concatenate(([True], r[1:] != r[:-1]))
        dense = np.empty(m, np.int64)
        dense[order] = np.cumsum(new) - 1
        return dense

    def direct(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes by comparison, a symbol at a time for the pairs that are still equal."""
        out, live, n = np.zeros(len(a), np.uint8), np.arange(len(a)), len(self.t)
        for k in range(CAP):
            x, y = self.t[np.minimum(a[live] + k, n - 1)], self.t[np.minimum(b[live] + k, n - 1)]
            live = live[(x == y) & (x > 0)]
            if not len(live):
                break
            out[live] = k + 1
        return out

    def sorted_lms(self, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """LMS places in order, and common prefixes of neighbours."""
        name, m = self.names(lms), len(lms)
        small = np.int32 if m < 2**31 - 2 else np.int64
        rounds, rank, width = [self._disk("rank0", name.astype(small))], name, 1
        while 2 * width <= self.depth + 1 and rank.max(initial=0) + 1 < m:  # an LMS substring adds two symbols at least
            second = np.zeros(m, np.int64)
            second[: m - width] = rank[width:] + 1
            key = rank.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64) if m < 2**31 else rank * (m + 1) + second
            order = np.argsort(key, kind="stable")
            k = key[order]
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(np.concatenate(([False], k[1:] != k[:-1])))
            rounds.append(self._disk(f"rank{len(rounds)}", rank.astype(small)))
            width *= 2
        order = np.argsort(rank, kind="stable")
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(rounds) - 1, -1, -1):
            inside = (a < m) & (b < m)
            same = np.zeros(len(a), bool)
            same[inside] = rounds[k][a[inside]] == rounds[k][b[inside]]
            a[same] += 1 << k
            b[same] += 1 << k
        ends = np.append(lms, len(self.t))
        common = np.minimum(ends[np.minimum(a, m)] - lms[order[:-1]], CAP)
        inside = np.flatnonzero((a < m) & (b < m))
        if len(inside):
            common[inside] = np.minimum(common[inside] + self.direct(lms[a[inside]], lms[b[inside]]), CAP)
        return lms[order], np.concatenate(([0], common)).astype(np.uint8)

    def _run(self, place: int) -> int:
        k, c, n = 1, self.t[place], len(self.t)
        while k < CAP and place + k < n and self.t[place + k] == c:
            k += 1
        return k

    def _scan(self, place: np.ndarray, common: np.ndarray, wanted: np.ndarray, queue: Queue, since: np.ndarray) -> None:
        """Pushes what a run of suffixes induces. since: for each symbol, the least common prefix since its last push."""
        if not len(place):
            return
        before = place - 1
        ok = np.flatnonzero((before >= 0) & wanted[before])
        lowest = int(common.min())
        if not len(ok):
            np.minimum(since, lowest, out=since)
            return
        target = self.t[before[ok]]
        table = range_minima(common)
        by = np.argsort(target, kind="stable")
        at, sym = ok[by], target[by]
        head = np.concatenate(([True], sym[1:] != sym[:-1]))
        low = np.empty(len(at), np.int16)
        inner = np.flatnonzero(~head)
        low[inner] = least(table, at[inner - 1] + 1, at[inner])
        heads = np.flatnonzero(head)
        low[heads] = np.minimum(since[sym[heads]], least(table, np.zeros(len(heads), np.int64), at[heads]))
        tails = np.append(heads[1:], len(at)) - 1
        np.minimum(since, lowest, out=since)
        rest = at[tails] + 1
        after = np.full(len(tails), CAP, np.int16)
        more = rest < len(place)
        after[more] = least(table, rest[more], np.full(int(more.sum()), len(place) - 1))
        since[sym[tails]] = after
        pushed, value = before[at], np.minimum(low + 1, CAP).astype(np.uint8)
        for a, b in zip(heads.tolist(), (tails + 1).tolist()):
            queue.spools[int(sym[a])].push(pushed[a:b], value[a:b])

    def _drained(self, spool: Spool, wanted: np.ndarray, queue: Queue, since: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All of a first symbol, in order: what waits, and what that induces with the same first symbol."""
        parts = []
        while len((got := spool.drain())[0]):
            self._scan(*got, wanted, queue, since)
            parts.append(got)
        if not parts:
            return np.zeros(0, self.kind), np.zeros(0, np.uint8)
        return np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])

    def run(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Runs of (places, common prefixes) in ascending order of suffixes, a first symbol at a time but from the last on."""
        t = self.t
        s = self._disk("types", self.types())
        lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
        lms, near = self.sorted_lms(lms)
        lms = lms.astype(self.kind)
        cuts = np.searchsorted(t[lms], np.arange(SYMBOLS + 1))
        large = np.empty(len(t), bool)
        np.logical_not(s, out=large)
        queue, kept = Queue(self.where, "l", self.kind, self.budget), Queue(self.where, "k", self.kind, self.budget)
        since = np.full(SYMBOLS, _NONE, np.int16)
        for c in range(SYMBOLS):
            place, common = self._drained(queue.spools[c], large, queue, since)
            kept.spools[c].push(place, common)
            seed, with_last = lms[cuts[c] : cuts[c + 1]], near[cuts[c] : cuts[c + 1]].copy()
            if len(seed):
                with_last[0] = min(self._run(int(place[-1])), self._run(int(seed[0]))) if len(place) else 0
                self._scan(seed, with_last, large, queue, since)
        queue, since = Queue(self.where, "s", self.kind, self.budget), np.full(SYMBOLS, _NONE, np.int16)
        # the last suffix is S and has none after it to induce it
        queue.spools[int(t[-1])].push(np.array([len(t) - 1], self.kind), np.zeros(1, np.uint8))
        for c in range(SYMBOLS - 1, -1, -1):
            small, above = self._drained(queue.spools[c], s, queue, since)
            place, common = kept.spools[c].drain()
            seam = min(self._run(int(place[-1])), self._run(int(small[-1]))) if len(place) and len(small) else 0
            if len(place):
                self._scan(place[::-1], np.concatenate(([seam], common[:0:-1])).astype(np.uint8), s, queue, since)
            if len(place) or len(small):
                # in ascending order, a suffix's common prefix with the one below is that of the one below with it
                up = np.concatenate((above[1:], [seam]))[::-1].astype(np.uint8) if len(small) else above
                yield np.concatenate((place, small[::-1])), np.concatenate((common, up))


def sort_file(path: str, depth: int = 100, budget: int = 256 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorts the suffixes of a file of 16-bit symbols; its work files are beside it while it runs."""
    where = tempfile.mkdtemp(dir=os.path.dirname(path))
    try:
        symbols = np.memmap(path, np.uint16, "r")
        if len(symbols):
            yield from SuffixSorter(symbols, where, depth, budget).run()
    finally:
        shutil.rmtree(where, ignore_errors=True)
