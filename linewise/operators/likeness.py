"""Texts beside the lines of their work that are most like them, many works at once in arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from .together import SIDE, in_order

#: Lines of a work that a task holds; wanted rows and pairs that it takes at once.
PART, ROWS, PAIRS = 20_000, 20_000, 1 << 21


def _ranges(low: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): for each owner i the places low[i], low[i] + 1, ..., counts[i] of them."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)


def _blocks(counts: np.ndarray, size: int) -> Iterator[slice]:
    """Slices whose counts add up to some `size`; one that has more stands alone."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        after = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield slice(at, after)
        at = after


class Pairs:
    """The distinct pairs of neighbouring characters of texts, the rarest first; a pair is a number in order of frequency."""

    def __init__(self, texts: pa.Array):
        plain = pc.replace_substring_regex(texts, f"[{T.BLANK}]+", "")
        codes = np.frombuffer("".join(plain.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(len(texts)), pc.utf8_length(plain).to_numpy(zero_copy_only=False))
        within = row[1:] == row[:-1]
        pair, row = ((codes[:-1] << 21) | codes[1:])[within], row[:-1][within]
        _, pair, times = np.unique(pair, return_inverse=True, return_counts=True)
        self.kinds = len(times) + 1
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(len(times))
        self.keys = np.unique(row * self.kinds + rank[pair])  # (text, pair) as one number, in order
        self.row, self.pair = np.divmod(self.keys, self.kinds)
        self.size = np.bincount(self.row, minlength=len(texts))
        self.start = np.cumsum(self.size) - self.size

    def prefixes(self, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(place in rows, pair): of n pairs the n - ceil(least x n) + 1 rarest."""
        n = self.size[rows]
        owner, place = _ranges(self.start[rows], np.where(n > 0, n - np.ceil(n * least - 1e-9).astype(np.int64) + 1, 0))
        return owner, self.pair[place]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many pairs the texts a[i] and b[i] have in common."""
        out = np.zeros(len(a), np.int64)
        for part in _blocks(self.size[a], PAIRS):
            owner, place = _ranges(self.start[a[part]], self.size[a[part]])
            key = b[part][owner] * self.kinds + self.pair[place]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[part] = np.bincount(owner[self.keys[at] == key], minlength=len(a[part]))
        return out


def most_alike(group: np.ndarray, texts: pa.Array, is_line: np.ndarray, number: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number, similarity) for rows that are no lines: the line of the group that is alike at `least` and most so; of equals the least number. 2 is the text itself."""
    kind = pc.dictionary_encode(texts).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # equal texts of a group are compared once
    whole = (group * 2 + is_line) * (int(kind.max(initial=0)) + 1) + kind
    order = np.lexsort((number, whole))
    _, first, same = np.unique(whole[order], return_index=True, return_inverse=True)
    rows = order[first]
    of = np.empty(len(whole), np.int64)
    of[order] = same  # each row's place in rows
    group, is_line, number, kind = group[rows], is_line[rows], number[rows], kind[rows]
    pairs = Pairs(texts.take(pa.array(rows)))
    lines, wanted = np.flatnonzero(is_line), np.flatnonzero(~is_line)
    best, value = np.full(len(rows), -1), np.zeros(len(rows))
    # a text that is a line
    width = int(kind.max(initial=0)) + 1
    known = {k: n for k, n in zip((group[lines] * width + kind[lines]).tolist(), number[lines].tolist(), strict=True)}
    for w, key in zip(wanted.tolist(), (group[wanted] * width + kind[wanted]).tolist(), strict=True):
        if key in known:
            best[w], value[w] = known[key], 2.0
    wanted = wanted[best[wanted] < 0]
    # the others meet on pairs of their prefixes, if their sizes allow it
    longest = int(pairs.size.max(initial=0)) + 2
    owner, pair = pairs.prefixes(lines, least)
    held = (group[lines][owner] * pairs.kinds + pair) * longest + pairs.size[lines][owner]
    order = np.argsort(held, kind="stable")
    held, line = held[order], lines[owner[order]]
    owner, pair = pairs.prefixes(wanted, least)
    asked, size = (group[wanted][owner] * pairs.kinds + pair) * longest, pairs.size[wanted][owner]
    low = np.searchsorted(held, asked + np.ceil(size * least - 1e-9).astype(np.int64), "left")
    high = np.searchsorted(held, asked + np.minimum(np.floor(size / least + 1e-9).astype(np.int64), longest - 1), "right")
    for part in _blocks(np.bincount(owner, high - low, len(wanted)).astype(np.int64), PAIRS):
        a, z = np.searchsorted(owner, [part.start, part.stop])
        i, place = _ranges(low[a:z], (high - low)[a:z])
        w, n = wanted[owner[a:z][i]], line[place]
        w, n = np.divmod(np.unique(w * len(rows) + n), len(rows))
        common = pairs.shared(w, n)
        alike = common / (pairs.size[w] + pairs.size[n] - common)
        good = alike >= least
        w, n, alike = w[good], number[n[good]], alike[good]
        order = np.lexsort((n, -alike, w))
        w, at = np.unique(w[order], return_index=True)
        best[w], value[w] = n[order][at], alike[order][at]
    found = np.flatnonzero(best[of] >= 0)
    found = found[value[of[found]] > 0]
    return found, best[of[found]], value[of[found]]


def nearest_lines(wanted: DataFrame, lines: DataFrame, least: float, on: str) -> DataFrame:
    """(on, item, line_no, similarity), some of an item: what most_alike finds in each part of the lines of a work; wanted are (on, item, text), lines (on, line_no, text).

    Both are shuffled once, by work and part of `PART` lines; a task holds the lines of a part and takes `ROWS` rows at once.
    """
    own = lines.withColumn("part", F.floor(F.col("line_no") / PART))
    last = own.filter("part > 0").groupBy(on).agg(F.max("part").alias("last"))  # few: only long works have more than one part
    asked = wanted.join(last, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("last", F.lit(0).cast("long"))))).drop("last")
    rows = in_order(own, asked, (on, "part")).select(on, "part", SIDE, "line_no", "item", "text")
    schema = f"{on} {wanted.schema[on].dataType.simpleString()}, item {wanted.schema['item'].dataType.simpleString()}, line_no {lines.schema['line_no'].dataType.simpleString()}, similarity double"
    kinds = StructType.fromDDL(schema)

    def found(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        key = _group_ids(table)
        column = lambda c: table.column(c).combine_chunks() if table.column(c).num_chunks != 1 else table.column(c).chunk(0)
        is_line = column(SIDE).to_numpy(zero_copy_only=False) == 0
        number = pc.fill_null(column("line_no").cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
        row, at, value = most_alike(key, column("text"), is_line, number, least)
        out = to_arrow_schema(kinds)
        own = table.take(pa.array(row))
        values = [own.column(on).combine_chunks(), own.column("item").combine_chunks(), pa.array(at), pa.array(value)]
        return pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, out, strict=True)], schema=out)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                table = pa.Table.from_batches(held)
                yield found(table)
                # rows of the last work may follow: its lines stay, and come before them
                key = _group_ids(table)
                stay = (key == key[-1]) & (table.column(SIDE).to_numpy() == 0)
                held = table.filter(pa.array(stay)).combine_chunks().to_batches()
        if held:
            yield found(pa.Table.from_batches(held))

    return rows.mapInArrow(read, schema)


def _group_ids(table: pa.Table) -> np.ndarray:
    """The number of each row's work and part among those of a table."""
    work = pc.dictionary_encode(table.column(0).combine_chunks())
    work = work.combine_chunks() if isinstance(work, pa.ChunkedArray) else work
    both = work.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (1 << 32) + table.column(1).to_numpy()
    return np.unique(both, return_inverse=True)[1]
