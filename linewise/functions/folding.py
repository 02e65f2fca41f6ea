"""Runs of copies in lines, for text.collapse_repeats: without a limit to the length of a copy, for many texts at once."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd

#: A copy has at least this many characters.
LEAST = 6
#: What ends a line, and the first of the numbers that stand for line ends: each has its own, so no run goes over one.
ENDS, END = np.array([0x0A, 0x0D, 0x85, 0x2028, 0x2029], np.uint32), 0x110000
#: Texts are taken together up to this many characters.
TOGETHER = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many values agree from the start on."""
    n, at, size = min(len(a), len(b)), 0, 64
    while at < n:
        differs = a[at : min(n, at + size)] != b[at : min(n, at + size)]
        if differs.any():
            return at + int(differs.argmax())
        at, size = at + size, size * 2
    return n


def runs(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, period, end) of the stretches where each code equals the one a period later, of two periods at least: three copies or more.

    Such a stretch holds a block that starts at a multiple of the period and equals the next block: only these are compared, n / period for
    each period, so n log n in all. Two blocks inside a run of a shorter period are part of that run and no more: they are passed over, as
    the shorter one is taken wherever they fit. Lines of under three periods are left out as periods grow.
    """
    place, low = np.arange(len(codes)), LEAST
    reach = np.zeros(len(codes), np.int64)  # the furthest end of a run that starts here or before
    while len(codes):
        lengths = np.diff(np.flatnonzero(codes >= END), prepend=-1)
        long = lengths > 3 * low
        if not long.any():
            return
        keep = np.repeat(long, lengths)
        codes, place, reach = codes[keep], place[keep], reach[keep]
        n, high = len(codes), min(4 * low, (int(lengths.max()) - 1) // 3 + 1)
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
        for p in range(low, high):
            marks = sums[::p]
            block = marks[1:] - marks[:-1]
            at = np.flatnonzero(block[:-1] * powers[p] == block[1:]) * p
            done = 0
            for b in at[reach[at] < place[at] + 2 * p].tolist():
                if b < done:
                    continue
                end = b + _agreeing(codes[b:], codes[b + p :])
                start = b - _agreeing(codes[:b][::-1], codes[p : b + p][::-1])
                done = end
                if end - start >= 2 * p:
                    first = int(place[start])
                    yield first, p, first + end - start
                    reach[start : end + p] = np.maximum(reach[start : end + p], first + end + p - start)
        low = high


def cuts(found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(from, to) of the copies that go: leftmost first, the shortest copy at each place."""
    found, fitting, k, at = sorted(found), [], 0, 0
    while True:
        while k < len(found) and found[k][0] <= at:
            heapq.heappush(fitting, found[k][1:])
            k += 1
        while fitting and at > fitting[0][1] - 2 * fitting[0][0]:
            heapq.heappop(fitting)
        if fitting:
            p, end = fitting[0]
            to = at + (1 + (end - at) // p) * p
            yield at + p, to
            at = to
        elif k < len(found):
            at = found[k][0]
        else:
            return


def folded(texts: list[str]) -> list[str | None]:
    """Each text with three or more copies of six characters or more made one, until nothing changes; None where nothing does."""
    out: list[str | None] = [None] * len(texts)
    now = dict(enumerate(texts))
    while now:
        codes = np.frombuffer(("\n".join(now.values()) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        marked = np.where(np.isin(codes, ENDS), np.arange(END, END + len(codes), dtype=np.uint32), codes)
        gone = list(cuts(list(runs(marked))))
        ends = np.cumsum([len(t) + 1 for t in now.values()])
        keep = np.ones(len(codes), bool)
        for a, b in gone:
            keep[a:b] = False
        changed = {}
        numbers = list(now)
        for i in np.unique(np.searchsorted(ends, [a for a, _ in gone], "right")).tolist():
            a, b = int(ends[i - 1]) if i else 0, int(ends[i]) - 1
            changed[numbers[i]] = out[numbers[i]] = codes[a:b][keep[a:b]].tobytes().decode("utf-32-le", "surrogatepass")
        now = changed
    return out


def folded_all(texts: pd.Series) -> pd.Series:
    """folded() of a batch, so many texts at a time that arrays stay small; null where nothing changes."""
    out: list[str | None] = [None] * len(texts)
    part, size = [], 0
    last = len(texts) - 1
    for i, text in enumerate(texts):
        if text and len(text) >= 3 * LEAST:
            part.append(i)
            size += len(text)
        if part and (size >= TOGETHER or i == last):
            for k, t in zip(part, folded([texts.iloc[k] for k in part]), strict=True):
                out[k] = t
            part, size = [], 0
    return pd.Series(out, dtype=object)
