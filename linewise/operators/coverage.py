"""What of a source is in a result: lines looked up in a text whole, in two halves, or without their numbers.

A text in which many lines are looked up is held with the order of its suffixes, so the longest beginning of a line that occurs anywhere in it takes one search among these; the longest ending takes one in the
text turned round. A line stands in two halves if beginning and ending together cover it: no cut is tried. A text and its suffixes (about 30 bytes a character) are in one task.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .together import met

#: How often a text is searched from its start before the order of its suffixes is made, which takes as long as about so many searches.
SCANS = 500
#: The shortest line and half that is looked up, and how often a line is in a source that is a running header.
SHORTEST, HEADER_TIMES = 6, 3


def suffixes(text: str) -> np.ndarray:
    """The places of a text in order of what starts there, by doubling the length that is compared."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    _, rank = np.unique(codes, return_inverse=True)
    width = 1
    order = np.argsort(rank, kind="stable")
    while width < len(codes):
        after = np.zeros(len(codes), np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (len(codes) + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64)))
        rank = np.empty(len(codes), np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == len(codes) - 1:
            break
        width *= 2
    return order


class Text:
    """A text in which lines are looked up."""

    def __init__(self, text: str):
        self.text, self.scans = text, 0

    @cached_property
    def order(self) -> np.ndarray:
        return suffixes(self.text)

    @cached_property
    def turned(self) -> Text:
        return Text(self.text[::-1])

    def beginning(self, line: str) -> int:
        """How many first characters of the line occur together."""
        if not self.text:
            return 0
        if self.scans < SCANS:
            return self._scanned(line)
        at = bisect_left(self.order, line, key=lambda i: self.text[i : i + len(line)])
        return max(self._common(line, int(i)) for i in self.order[max(0, at - 1) : at + 1])

    def _scanned(self, line: str) -> int:
        low, high = 0, len(line)
        if self.holds(line):
            return high
        high -= 1
        while low < high:  # if a beginning occurs, so do those shorter than it
            middle = (low + high + 1) // 2
            self.scans += 1
            low, high = (middle, high) if line[:middle] in self.text else (low, middle - 1)
        return low

    def _common(self, line: str, i: int) -> int:
        own = self.text[i : i + len(line)]
        low, high = 0, len(own)
        while low < high:  # the longest common beginning
            middle = (low + high + 1) // 2
            low, high = (middle, high) if own[:middle] == line[:middle] else (low, middle - 1)
        return low

    def holds(self, line: str) -> bool:
        if self.scans < SCANS:
            self.scans += 1
            return line in self.text
        return self.beginning(line) == len(line)

    def holds_halves(self, line: str, shortest: int = SHORTEST) -> bool:
        """Whether some cut leaves two parts of that many characters that both occur."""
        first = min(self.beginning(line), len(line) - shortest)
        return first >= shortest and self.turned.beginning(line[::-1]) >= len(line) - first


def contained_lines(needles: DataFrame, texts: DataFrame, on: str = "work") -> DataFrame:
    """needles (on, line_no, text) with `covered`: whether the comparable form of the line is part of the work's text, whole or in two halves."""
    number = needles.schema["line_no"].dataType.simpleString()
    kind = needles.schema[on].dataType.simpleString()
    rows = needles.select(on, "line_no", "text", T.comparable(F.col("text")).alias("needle"))
    own = texts.select(on, T.comparable(F.col("text")).alias("hay"))

    def look_up(texts: list[Text], row: tuple) -> list[tuple]:
        needle = row[3]
        return [(*row[:3], needle is not None and any(t.holds(needle) or (len(needle) >= 2 * SHORTEST and t.holds_halves(needle)) for t in texts))]

    begin = lambda own: [Text(hay) for _, hay in own if hay is not None]
    return met(own, rows, (on,), begin, look_up, f"{on} {kind}, line_no {number}, text string, covered boolean")


def coverage(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(work, line_no, text, category) for the lines of a source that are judged: all but furniture and lines of under six letters and numbers.

    `kept` lines are in the work's text, whole or in two halves. Of others, `title` stand before the first scene, `header` are lines that the source has three times or more,
    `number` are kept but for numbers at their ends, and `body` are lost. texts have (work, text); a work without a text has lost everything.
    """
    t = T.trim(F.col("text"))
    bare = T.trim(T.sub(T.sub(t, r"^\s*\d{1,4}[A-Z]?\.?\s+"), r"\s*\d{1,4}[A-Z]?\.?\s*\*?\s*$"))
    whole = W.partitionBy("work")
    first = F.min(F.when(T.follows(t, "first scene"), F.col("line_no"))).over(whole)
    key = T.comparable(t)
    rows = lines.select("work", "line_no", "text", key.alias("key"), T.comparable(bare).alias("bare"), T.follows(t, "furniture of a source").alias("furniture"), first.alias("first"))
    rows = rows.withColumn("title", F.coalesce(F.col("line_no") < F.col("first"), F.lit(False)))
    rows = rows.filter(F.length("key") >= SHORTEST).withColumn("times", F.count(F.lit(1)).over(W.partitionBy("work", "key"))).filter("not furniture")
    kind, number = (lines.schema[c].dataType.simpleString() for c in ("work", "line_no"))
    own = texts.select("work", T.comparable(F.col("text")).alias("hay"))
    rows = rows.select("work", "line_no", "text", "key", "bare", "title", "times")

    def judge(text: Text, row: tuple) -> list[tuple]:
        work, line_no, line, key, bare, title, times = row
        if text.holds(key) or text.holds_halves(key):
            category = "kept"
        elif title:
            category = "title"
        elif times >= HEADER_TIMES:
            category = "header"
        else:
            category = "number" if len(bare) >= SHORTEST and text.holds(bare) else "body"
        return [(work, line_no, line, category)]

    begin = lambda own: Text("".join(hay or "" for _, hay in own))
    return met(own, rows, ("work",), begin, judge, f"work {kind}, line_no {number}, text string, category string")


def coverage_report(judged: DataFrame) -> DataFrame:
    """(work, checked, body, title, header, number, percent): how many lines were judged, and lost by category; percent is of those that are not lost from the body."""
    count = lambda c: F.sum((F.col("category") == c).cast("long")).alias(c)
    rows = judged.groupBy("work").agg(F.count(F.lit(1)).alias("checked"), *map(count, ("body", "title", "header", "number")))
    return rows.withColumn("percent", 100 * (F.col("checked") - F.col("body")) / F.col("checked"))
