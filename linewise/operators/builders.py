"""Typed blocks of scripts in one ordered pass: table functions that take the lines of a work in order and carry the states.

What a line looks like is said by column expressions before; the functions see flags. The lines of one work meet in one task, with one shuffle; measures of the whole
work (columns, height of lines, full lengths) are taken from the same lines before the pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import RULES


def nearest(values: list, share: float):
    """The value at place min(n - 1, floor(n x share)) of the values in order."""
    return sorted(values)[min(len(values) - 1, math.floor(len(values) * share))] if values else None


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


@cache
def compiled(pattern: str) -> re.Pattern:
    """A pattern as the engine reads it: its names of characters are four digits here."""
    loose = pattern.startswith("(?i)")
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m[1].zfill(4), T.rx(pattern[4:] if loose else pattern, loose)))


def follows(text: str, name: str) -> bool:
    """Whether a text follows a rule, outside the engine."""
    found = lambda p: compiled(p).search(text) is not None
    rule = RULES[name]
    return all(map(found, rule.every)) and (not rule.some or any(map(found, rule.some))) and not any(map(found, rule.never))


def clumps(places: list[tuple[int, int]], gap: int = 14) -> list[tuple[int, int, int]]:
    """(low, peak, n) of places (x, n) no more than `gap` apart; the peak is the fullest of them, the leftmost of equals."""
    out: list[list[tuple[int, int]]] = []
    for place in sorted(places):
        if out and place[0] - out[-1][-1][0] <= gap:
            out[-1].append(place)
        else:
            out.append([place])
    return [(own[0][0], max(own, key=lambda p: (p[1], -p[0]))[0], sum(n for _, n in own)) for own in out]


def columns_of(starts: Counter, cues: Counter) -> tuple[int, int, int]:
    """(dialogue, character, transition): where columns start, from how often lines, and lines that name speakers, start at each place of five points."""
    total = sum(starts.values())
    fullest = [x for x, _ in sorted(starts.items(), key=lambda p: (-p[1], p[0]))[:3]]
    speakers = max(cues, key=lambda x: (cues[x], -x), default=None)
    if speakers is None or cues[speakers] < 5:
        action = min(fullest)
        return action + 50, action + 110, action + 320
    solid = [(x, n) for x, n in starts.items() if n >= max(3.0, total * 0.003)]
    left = clumps([p for p in solid if p[0] < speakers - 50])
    most = [peak for _, peak, _ in sorted(left, key=lambda c: (-c[2], c[0]))[:3]]
    action = min([peak for _, peak, n in left if n >= total * 0.05] or most or [speakers - 220])
    between = [c for c in clumps([p for p in solid if action + 40 <= p[0] < speakers - 20]) if c[2] >= 20]
    half = half_up((action + speakers - 20) / 2)
    speech = max(between, key=lambda c: (c[2], -c[0]))[1] - 8 if between else half
    return min(speech, half), speakers - 20, speakers + 300


_DASH_END, _DASH_START, _COLON, _BRACKETS, _MARK = (compiled(p) for p in (r"\s*[-–—]\s*$", r"^\s*[-–—]\s*", r"[:：]\s*$", r"^\(+|\)+$", r"^[-@#]\s*"))


class Blocks:
    """The blocks of a work as its lines are taken in."""

    def __init__(self):
        self.rows: list[tuple[str, list[str]]] = []
        self.open = False  # whether the next line can go on in the last block

    def add(self, kind: str, text: str, goes_on: bool = False) -> None:
        if goes_on and self.open:
            self.rows[-1][1].append(text)
        else:
            self.rows.append((kind, [text]))
        self.open = True

    def end(self) -> None:
        self.open = False

    def joined_headings(self) -> Blocks:
        """Headings that end in a dash go on in the headings after them."""
        kept: list[tuple[str, list[str]]] = []
        dangling = False
        for kind, parts in self.rows:
            if dangling and kind == "scene":
                kept[-1][1].append(_DASH_START.sub("", parts[0]))
            else:
                kept.append((kind, list(parts)))
            dangling = kind == "scene" and _DASH_END.search(parts[0]) is not None
        for kind, parts in kept:
            if kind == "scene":
                parts[:] = [" - ".join([*(_DASH_END.sub("", p) for p in parts[:-1]), parts[-1]])]
        self.rows = kept
        return self

    def marked(self, most: int, share: float, shortest: int) -> list[tuple[str, str]]:
        """(type, text with its mark); what stands before a first scene that comes early goes, but for cards, transitions and other prose."""
        out = []
        for kind, parts in self.rows:
            t = " ".join(parts)
            text = {
                "scene": lambda t=t: "# " + t, "character": lambda t=t: "@" + _COLON.sub("", t).strip(T.BLANKS),
                "transition": lambda t=t: "(" + _BRACKETS.sub("", t).strip(T.BLANKS) + ")", "dialogue": lambda t=t: "- " + t,
            }.get(kind, lambda t=t: t)()
            out.append((kind, text))
        first = next((i for i, (kind, _) in enumerate(out) if kind == "scene"), 0)
        if not 0 < first <= (min(most, math.floor(len(out) * share)) if share < 1 else len(out)):
            return out
        return [b for b in out[:first] if self.stays(*b, shortest)] + out[first:]

    @staticmethod
    def stays(kind: str, text: str, shortest: int) -> bool:
        """Whether a block of a title page is kept."""
        if kind != "action":
            return kind == "transition"
        t = _MARK.sub("", text).strip(T.BLANKS)
        return t != "" and (follows(t, "title card") or (not follows(t, "title page text") and len(t) >= shortest))


class PageBuilder:
    """A table function: the lines of a work on pages, in order, to (work, block_no, type, text)."""

    def __init__(self):
        self.lines: list = []

    def eval(self, line) -> None:
        self.lines.append(line)

    def terminate(self) -> Iterator[tuple]:
        lines = self.lines
        if not lines:
            return
        dialogue, character, transition = self.columns()
        kinds = [self.kind(r, dialogue, character, transition) for r in lines]
        gaps = [half_up(a.y - b.y) for a, b in pairwise(lines) if a.page == b.page and a.y is not None and b.y is not None]
        wide = sorted(g for g in gaps if g > 2)
        height = wide[len(gaps) // 2] if len(gaps) // 2 < len(wide) else 14
        narrow = [r for r in lines if r.x is not None and r.x < character and r.length is not None]
        full = {"dialogue": nearest([r.length for r in narrow if r.x >= dialogue], 0.92), "action": nearest([r.length for r in narrow if r.x < dialogue], 0.92)}
        by_number = sum(r.number_head is not None for r in lines) >= 10

        blocks, seen, after, prev = Blocks(), False, None, None  # after: the last line's type, remarks aside; prev: the last line, with the type it got
        for i, r in enumerate(lines):
            if r.skipped:
                continue
            kind = kinds[i]
            if by_number and r.number_head is not None:
                pieces = [("scene", r.number_head), *([("action", r.number_rest)] if r.number_rest is not None else [])]
            else:
                pieces = [(kind, r.heading_text if kind == "scene" else r.t)]
            for raw, text in pieces:
                if raw == "scene" and (text == "" or follows(text, "omitted")):
                    continue
                got = "dialogue" if raw == "action" and after == "character" else raw
                if raw != "paren":
                    after = raw
                goes_on = got in full and prev is not None and prev[1] == got and not self.apart(prev[0], r, height)
                if goes_on and not seen and full[got] is not None:
                    goes_on = full[got] - prev[0].length <= 20
                seen, prev = seen or raw == "scene", (r, got)
                following = lines[i + 1] if i + 1 < len(lines) else None
                if raw == "character" and (following is None or (following.page != r.page and kinds[i + 1] != "dialogue")):
                    blocks.end()  # a speaker left over at the end of a page
                else:
                    blocks.add(got, text, goes_on)
        for n, (kind, text) in enumerate(blocks.joined_headings().marked(40, 0.05, 0)):
            yield lines[0].work, n, kind, text

    def columns(self) -> tuple[float, float, float]:
        if self.lines[0].dialogue is not None:
            return self.lines[0].dialogue, self.lines[0].character, self.lines[0].transition
        placed = [(half_up(r.x / 5) * 5, r.cue) for r in self.lines if r.x is not None]
        return columns_of(Counter(x for x, _ in placed), Counter(x for x, cue in placed if cue)) if placed else (50, 110, 320)

    @staticmethod
    def kind(r, dialogue: float, character: float, transition: float) -> str:
        x = -math.inf if r.x is None else r.x
        if r.heading:
            return "scene"
        if r.change or x >= transition:
            return "transition"
        if x >= character and r.cue:
            return "character"
        if r.paren:
            return "paren"
        return "dialogue" if dialogue <= x < character else "action"

    @staticmethod
    def apart(a, b, height: float) -> bool:
        return a.page != b.page or (a.y is not None and b.y is not None and a.y - b.y > height * 1.7)


class IndentBuilder:
    """A table function: the lines of a work, in order, with their indentation, to (work, block_no, type, text)."""

    def __init__(self):
        self.lines: list = []

    def eval(self, line) -> None:
        self.lines.append(line)

    def terminate(self) -> Iterator[tuple]:
        lines = self.lines
        named = [r.ind for r in lines if r.t and r.cue]
        cue_at = nearest(named, 0.25) if len(named) >= 20 else 30
        speech_at = max(4, half_up(cue_at * 0.45))
        blocks, after, at, before = Blocks(), None, None, None  # at: where speech last stood since the last scene, transition or speaker
        for r in lines:
            if r.skipped:
                continue
            raw = self.kind(r, cue_at, speech_at)
            if raw in ("scene", "transition", "character"):
                at = None
            got = raw
            if raw == "action" and (after == "character" or (at is not None and abs(r.ind - at) <= 2)):
                got = "dialogue"
            if got == "dialogue":
                at = r.ind
            if raw not in ("paren", "blank"):
                after = raw
            if raw == "blank":
                blocks.end()
            else:
                blocks.add(got, r.heading_text if raw == "scene" else r.t, got in ("dialogue", "action") and before == got)
            before = got
        for n, (kind, text) in enumerate(blocks.marked(0, 1, 45)):
            yield lines[0].work, n, kind, text

    @staticmethod
    def kind(r, cue_at: float, speech_at: float) -> str:
        if r.t == "":
            return "blank"
        if r.heading:
            return "scene"
        if r.change:
            return "transition"
        if r.paren:
            return "paren"
        if r.ind >= cue_at - 2 and r.cue:
            return "character"
        return "dialogue" if r.ind >= speech_at else "action"


def built(lines: DataFrame, builder: type, *order: str) -> DataFrame:
    """(work, block_no, type, text): what a builder makes of the lines of each work in order; a null work is a work."""
    kind = lines.schema["work"].dataType.simpleString()
    function = F.udtf(builder, returnType=f"work {kind}, block_no int, type string, text string")
    return function(lines.asTable().partitionBy("work").orderBy(*order))


def flags(**columns: Column) -> list[Column]:
    """Columns of flags; what is null is false."""
    return [F.coalesce(c, F.lit(False)).alias(name) for name, c in columns.items()]
