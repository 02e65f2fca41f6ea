"""Alignments and greedy packing: sequential by nature, so each work is one group of a grouped Arrow-backed function.

Pairings of two sequences keep a row of bits for every so many places and compute the rest anew where it is read, so their memory grows with the
length of a work, not with its square: 100,000 blocks a side take some 20 MB.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Hashable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

#: Narration of two scenes goes together where the second has 0.25 to 2.8 times the characters of the first, or both have under 5. Fixed values.
SHORTEST, LONGEST, TINY = 0.25, 2.8, 5


def pairing(n: int, m: int, mask: Callable[[int], int]) -> list[tuple[int, int]]:
    """Pairs (i, j) of most places of two sequences in order; mask(i) has bit m - 1 - j where i and j may go together.

    Two places that may go together are taken whenever both are next; else the place of the first sequence is passed over if that loses no pair, else that of the second.

    In the row of bits of place i, zeros in the lowest m - j bits number the pairs that the sequences can still have from i and j on. A row follows from the
    one after it by one addition over all bits. Every r-th row is kept, r the root of n, and the rows between are computed again when the pairs are read.
    """
    every, full = max(1, math.isqrt(n)), (1 << m) - 1

    def before(row: int, i: int) -> int:
        met = row & mask(i)
        return ((row + met) | (row - met)) & full

    kept, row = {n: full}, full
    for i in range(n - 1, -1, -1):
        row = before(row, i)
        if i % every == 0:
            kept[i] = row
    width = -(-m // 8)
    bits = lambda x: x.to_bytes(width, "little")
    at = lambda x, k: x[k >> 3] >> (k & 7) & 1
    left = lambda row, j: m - j - (row & (1 << m - j) - 1).bit_count()  # noqa: E731  pairs from a row's place and j on
    found, i, j, rows = [], 0, 0, []
    here, here_left = bits(kept[0]) if n else b"", left(kept[0], 0)
    while i < n and j < m:
        if not rows:  # the rows from i + 1 to the next that is kept, the first one last
            rows = [kept[min(n, (i // every + 1) * every)]]
            for k in range(min(n, (i // every + 1) * every) - 1, i, -1):
                rows.append(before(rows[-1], k))
        row = rows.pop()
        below, may, below_left = bits(row), bits(mask(i)), left(row, j)
        while j < m:
            k = m - 1 - j
            if at(may, k):
                found.append((i, j))
                below_left, j = below_left - (1 - at(below, k)), j + 1
                break
            right = here_left - (1 - at(here, k))
            if below_left >= right:
                break
            here_left, below_left, j = right, below_left - (1 - at(below, k)), j + 1
        here, here_left, i = below, below_left, i + 1
    return found


def equal_masks(a: Sequence[Hashable], b: Sequence[Hashable]) -> Callable[[int], int]:
    """Masks of the places that hold equal values."""
    places: dict[Hashable, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(len(b) - 1 - j)

    @lru_cache(maxsize=256)
    def of_value(x: Hashable) -> int:
        own = places.get(x, [])
        return sum(1 << k for k in own) if len(own) < 9 else _as_bits(np.bincount(own, minlength=len(b)).astype(bool))

    return lambda i: of_value(a[i])


def length_masks(a: Sequence[int], b: Sequence[int]) -> Callable[[int], int]:
    """Masks of the places whose lengths are alike."""
    lengths = np.array(b[::-1], np.float64)

    @lru_cache(maxsize=256)
    def of_length(x: int) -> int:
        ratio = lengths / max(x, 1)
        return _as_bits((ratio >= SHORTEST) & (ratio <= LONGEST) | ((lengths < TINY) & (x < TINY)))

    return lambda i: of_length(a[i])


def _as_bits(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _cogrouped(a: DataFrame, b: DataFrame, order: str, value: str, masks: Callable) -> DataFrame:
    def align(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values(order), right.sort_values(order)
        x, y = left[value].tolist(), right[value].tolist()
        i, j = np.array(pairing(len(x), len(y), masks(x, y)), np.int64).reshape(-1, 2).T
        return pd.DataFrame({"work": [key[0]] * len(i), "a": left[order].to_numpy()[i], "b": right[order].to_numpy()[j]})

    kind = a.schema["work"].dataType.simpleString()
    own = lambda rows: rows.select("work", order, value).groupBy("work")
    return own(a).cogroup(own(b)).applyInPandas(align, f"work {kind}, a long, b long")


def align_markers(a: DataFrame, b: DataFrame, order: str = "block_no", value: str = "type") -> DataFrame:
    """(work, a, b): places of two versions of a work that a longest common subsequence of their markers pairs."""
    return _cogrouped(a, b, order, value, equal_masks)


def narration_lengths(lines: DataFrame) -> DataFrame:
    """(work, scene_no, heading, length): the scenes of a script in order, with the characters of their narration.

    Cues, speech and lines that begin with a bracket are no narration. Scenes marked as omitted are left out with all their lines and numbers.
    """
    headed = F.col("text").startswith("# ")
    order = W.partitionBy("work").orderBy("line_no")
    rows = lines.withColumn("heading", F.last(F.when(headed, T.trim(F.col("text"))), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.filter(F.col("heading").isNotNull() & ~T.follows(F.col("heading"), "omitted scene"))
    rows = rows.withColumn("scene_no", F.sum(headed.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)) - 1)
    told = ~(headed | F.col("text").startswith("@") | F.col("text").startswith("- ") | F.col("text").startswith("("))
    return rows.groupBy("work", "scene_no").agg(F.first("heading").alias("heading"), F.sum(F.when(told, F.length("text")).otherwise(0)).alias("length"))


def align_lengths(a: DataFrame, b: DataFrame, order: str = "scene_no", value: str = "length") -> DataFrame:
    """(work, a, b): scenes of two versions paired in order by how much narration they have, as many as can be."""
    return _cogrouped(a, b, order, value, length_masks)


def unpaired(pairs: DataFrame, a: DataFrame, b: DataFrame, order: str = "scene_no") -> DataFrame:
    """(work, side, place): what a pairing leaves over on its sides a and b."""
    left = a.select("work", F.col(order).cast("long").alias("a")).join(pairs, ["work", "a"], "left_anti")
    right = b.select("work", F.col(order).cast("long").alias("b")).join(pairs, ["work", "b"], "left_anti")
    return left.select("work", F.lit("a").alias("side"), F.col("a").alias("place")).union(right.select("work", F.lit("b"), F.col("b")))


def resumed(a: DataFrame, b: DataFrame, order: str = "scene_no") -> DataFrame:
    """(work, a, b): scenes of a new and an old version that go together: as many cues, and lines within one; one scene may be skipped on either side.

    Both have (work, scene_no, cues, lines). Works where under 70 % of the new scenes find one are left out.
    """

    def align(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values(order), right.sort_values(order)
        x, y = (list(zip(d["cues"], d["lines"], strict=True)) for d in (left, right))
        fits = lambda i, j: i < len(x) and j < len(y) and x[i][0] == y[j][0] and abs(x[i][1] - y[j][1]) <= 1
        found, i, j = [], 0, 0
        while i < len(x) and j < len(y):
            if not fits(i, j):
                if fits(i + 1, j):
                    i += 1
                elif fits(i, j + 1):
                    j += 1
                else:
                    i, j = i + 1, j + 1
                    continue
            found.append((key[0], left[order].iloc[i], right[order].iloc[j]))
            i, j = i + 1, j + 1
        return pd.DataFrame(found if len(found) >= 0.7 * len(x) else [], columns=["work", "a", "b"])

    kind = a.schema["work"].dataType.simpleString()
    return a.groupBy("work").cogroup(b.groupBy("work")).applyInPandas(align, f"work {kind}, a long, b long")


def regroup(blocks: DataFrame, groups: int, order: str = "block_no") -> DataFrame:
    """Blocks with `group`: the n blocks of a work cut into as many groups, at the rounded multiples of n / groups."""
    rn, n = F.row_number().over(W.partitionBy("work").orderBy(order)) - 1, F.count(F.lit(1)).over(W.partitionBy("work"))
    rows = blocks.withColumn("rn", rn).withColumn("n", n)
    group = F.expr(f"size(filter(sequence(1, {groups}), g -> floor(g * (n / {groups}D) + 0.5D) <= rn))")
    return rows.withColumn("group", F.least(group, F.lit(groups - 1))).drop("rn", "n")


def _numbered(rows: DataFrame, starts: DataFrame, order: str, name: str) -> DataFrame:
    """(work, order, name): rows numbered by how many of the starts (work, starts) they have reached, from 0; the first row needs no start."""
    marks = starts.select("work", F.explode("starts").alias(order), F.lit(1).alias("start"))
    number = F.sum(F.coalesce("start", F.lit(0))).over(W.partitionBy("work").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.join(marks, ["work", order], "left").select("work", order, number.cast("int").alias(name))


def pack(sized: DataFrame, short: int = 25, most: int = 3, budget: int = 60, order: str = "scene_no") -> DataFrame:
    """(work, scene_no, batch): scenes in batches, greedily and in order: short ones together, up to `most` and `budget` lines; others alone.

    sized has (work, scene_no, lines, heading). A fold over each work's scenes, inside the engine, keeps only where batches start.
    """
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("lines"), F.array().cast("array<bigint>").alias("starts"), F.lit(True).alias("first"))

    def step(acc, x):
        fits = x["short"] & (acc["n"] > 0) & (acc["n"] < most) & (acc["lines"] + x["lines"] <= budget)
        n = F.when(~x["short"], 0).when(fits, acc["n"] + 1).otherwise(1)
        lines = F.when(~x["short"], 0).when(fits, acc["lines"] + x["lines"]).otherwise(x["lines"])
        starts = F.when(fits | acc["first"], acc["starts"]).otherwise(F.array_append(acc["starts"], x["scene_no"]))
        return F.struct(n.alias("n"), lines.alias("lines"), starts.alias("starts"), F.lit(False).alias("first"))

    rows = sized.withColumn(order, F.col(order).cast("long"))
    scenes = F.array_sort(F.collect_list(F.struct(F.col(order).alias("scene_no"), F.col("lines").cast("int").alias("lines"), ((F.col("lines") <= short) & F.col("heading")).alias("short"))))
    starts = rows.groupBy("work").agg(F.aggregate(scenes, zero, step, lambda acc: acc["starts"]).alias("starts"))
    return _numbered(rows, starts, order, "batch").withColumnRenamed(order, "scene_no")


def chunk_by_size(blocks: DataFrame, limit: int = 8000, order: str = "block_no") -> DataFrame:
    """(work, block_no, chunk): blocks in chunks of under `limit` characters, greedily and in order. The fold keeps only where chunks start."""
    zero = F.struct(F.lit(0).alias("size"), F.array().cast("array<bigint>").alias("starts"))

    def step(acc, x):
        new = (acc["size"] > 0) & (acc["size"] + x["size"] >= limit)
        starts = F.when(new, F.array_append(acc["starts"], x["block_no"])).otherwise(acc["starts"])
        return F.struct(F.when(new, x["size"]).otherwise(acc["size"] + x["size"]).alias("size"), starts.alias("starts"))

    rows = blocks.withColumn(order, F.col(order).cast("long"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("block_no"), F.length("text").alias("size"))))
    starts = rows.groupBy("work").agg(F.aggregate(ordered, zero, step, lambda acc: acc["starts"]).alias("starts"))
    return _numbered(rows, starts, order, "chunk").withColumnRenamed(order, "block_no")


_MARKER, _WORD = re.compile(r"(?m)^[-@#]\s*"), re.compile(r"[A-Za-z][A-Za-z']*|\d+")


def compared_words(text: str | None) -> list[str]:
    """The words and numbers of a text without its markers, in lower case and with straight apostrophes."""
    plain = _MARKER.sub(" ", text or "").replace("\u2019", "'").replace("\u2018", "'")
    return [w.lower() for w in _WORD.findall(plain)]


def reading_accuracy(pairs: DataFrame) -> DataFrame:
    """(work, words, equal, replaced, deleted, inserted, accuracy) of a reading against a reference; pairs have (work, reference, reading).

    Words are paired by a longest common subsequence, so `equal` is the most that any alignment in order finds. Where the texts differ between
    pairs, one word for one is replaced; words of the reference alone are deleted, words of the reading alone inserted.
    """

    def score(batches):
        for pdf in batches:
            rows = []
            for work, reference, reading in zip(pdf["work"], pdf["reference"], pdf["reading"], strict=True):
                a, b = compared_words(reference), compared_words(reading)
                found = pairing(len(a), len(b), equal_masks(a, b))
                gaps = [(i - x - 1, j - y - 1) for (x, y), (i, j) in zip([(-1, -1), *found], [*found, (len(a), len(b))], strict=True)]
                rows.append((work, len(a), len(found), gaps.count((1, 1)), sum(x for x, y in gaps if not y), sum(y for x, y in gaps if not x), len(found) / max(len(a), 1)))
            yield pd.DataFrame(rows, columns=["work", "words", "equal", "replaced", "deleted", "inserted", "accuracy"])

    kind = pairs.schema["work"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("words", "equal", "replaced", "deleted", "inserted"))
    return pairs.select("work", "reference", "reading").mapInPandas(score, f"work {kind}, {counts}, accuracy double")
