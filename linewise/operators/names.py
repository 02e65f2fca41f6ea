"""Names and marks of a work looked up in its lines: one automaton of all patterns of a work reads each line once.

A work's lines meet its patterns in parts of `PART` lines, so the lines of a long work are several groups. Work grows with the text and the patterns, not with
their product.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .together import met

PART = 50_000
#: What a sentence ends in before a name; how much of an address is its mark, how often marks and stamps return; how much of a line begins it anew.
SENTENCE_END = re.compile("[.!?…\"”'’)\\]]$")
ADDRESS, ADDRESS_MARK, ADDRESS_TIMES, STAMP_TIMES, HEAD = re.compile(r"\S*https?://\S+"), 40, 5, 3, 20


class Patterns:
    """Patterns to be found in texts."""

    def __init__(self, patterns: Iterable[str]):
        self.automaton = ahocorasick.Automaton()
        self.longest = 0
        for p in patterns:
            if p:
                self.automaton.add_word(p, p)
                self.longest = max(self.longest, len(p))
        self.some = len(self.automaton) > 0
        if self.some:
            self.automaton.make_automaton()

    def __contains__(self, text: str) -> bool:
        return self.some and self.automaton.exists(text)

    def within(self, text: str) -> set[str]:
        """The patterns that a text has."""
        return {p for _, p in self.automaton.iter(text)} if self.some else set()

    def at_start(self, text: str) -> str | None:
        """The longest pattern that a text starts with."""
        found = (p for end, p in self.automaton.iter(text[: self.longest]) if end == len(p) - 1) if self.some else ()
        return max(found, key=len, default=None)

    def at_end(self, text: str) -> str | None:
        """The longest pattern that a text ends with, after a blank."""
        start = max(0, len(text) - self.longest - 1)
        tail = text[start:]
        found = (p for end, p in self.automaton.iter(tail) if end == len(tail) - 1 and end >= len(p) and tail[end - len(p)] == " ") if self.some else ()
        return max(found, key=len, default=None)

    def cut_out(self, text: str, by: str = " ") -> str:
        """The text with `by` for all patterns: the leftmost, and of those the longest, first."""
        if not self.some:
            return text
        longest: dict[int, str] = {}
        for end, p in self.automaton.iter(text):
            if len(p) > len(longest.get(start := end + 1 - len(p), "")):
                longest[start] = p
        out, at = [], 0
        for start in sorted(longest):
            if start >= at:
                out += [text[at:start], by]
                at = start + len(longest[start])
        return "".join([*out, text[at:]])


def with_patterns(
    lines: DataFrame, patterns: DataFrame, each: Callable[[str, int, object], Iterable[tuple]], schema: str, begin: Callable[[list[tuple]], object] = lambda rows: Patterns(p for (p,) in rows),
) -> DataFrame:
    """(work, line_no, ...): what `each` gives for the text and number of each line and what `begin` made of the patterns of its work; patterns have (work, pattern), and more if begin takes it."""
    rows = lines.select("work", "line_no", F.coalesce("text", F.lit("")).alias("text"), F.floor(F.col("line_no") / PART).alias("part"))
    last = rows.filter("part > 0").groupBy("work").agg(F.max("part").alias("last"))  # only long works have more than one part
    zero = F.lit(0).cast("long")
    own = patterns.filter("work IS NOT NULL").distinct().join(last, "work", "left").withColumn("part", F.explode(F.sequence(zero, F.coalesce("last", zero))))
    own = own.select("work", "part", *[c for c in patterns.columns if c != "work"])
    rows = rows.select("work", "part", "line_no", "text")
    kind, number = (lines.schema[c].dataType.simpleString() for c in ("work", "line_no"))

    def look_up(found: object, row: tuple) -> Iterable[tuple]:
        work, _, n, text = row
        return [(work, n, *out) for out in each(text, n, found)]

    return met(own, rows, ("work", "part"), lambda own: begin([r[2:] for r in own]), look_up, f"work {kind}, line_no {number}, {schema}")


def cue_names(lines: DataFrame) -> DataFrame:
    """(work, pattern): the names in a work's cues, of two characters or more."""
    cue = T.trim(F.element_at(F.split(F.regexp_replace("text", "^@", ""), r"\("), 1))
    return lines.filter(F.col("text").startswith("@")).select("work", cue.alias("pattern")).filter(F.length("pattern") >= 2).distinct()


def merged_cues(lines: DataFrame) -> DataFrame:
    """(work, line_no, speech, cue): speech that holds the name of a speaker of the work: all of it (then speech is null), or at its end after a sentence.

    Of names at the end the longest counts; where no sentence ends before it the line stays.
    """

    def each(text: str, n: int, names: Patterns) -> Iterable[tuple]:
        said = text.strip(T.BLANKS)
        if not said.startswith("- "):
            return
        body = said[2:].strip(T.BLANKS)
        if body in names:
            yield None, body
        elif name := names.at_end(body):
            head = body[: -len(name) - 1].strip(T.BLANKS)
            if SENTENCE_END.search(head):
                yield "- " + head, name

    return with_patterns(lines, cue_names(lines), each, "speech string, cue string")


def with_cues_split(lines: DataFrame) -> DataFrame:
    """Lines with the cues of merged_cues on lines of their own, after a blank line where speech stays before them; numbered anew."""
    found = merged_cues(lines)
    rows = lines.select("work", "line_no", "text").join(found, ["work", "line_no"], "left")
    cue = F.concat(F.lit("@"), "cue")
    parts = F.when(F.col("cue").isNull(), F.array("text")).when(F.col("speech").isNull(), F.array(cue)).otherwise(F.array(F.col("speech"), F.lit(""), cue))
    rows = rows.select("work", "line_no", F.posexplode(parts).alias("part", "text"))
    return rows.select("work", (F.row_number().over(W.partitionBy("work").orderBy("line_no", "part")) - 1).alias("line_no"), "text")


def stamps(lines: DataFrame, least: int = STAMP_TIMES) -> DataFrame:
    """(work, stamp, n): lines like a publisher's stamp, with how often a work has them, alone or within other lines, from where they first stand alone."""
    t = T.trim(F.col("text"))
    rows = lines.select("work", "line_no", t.alias("text"))
    own = rows.filter(T.follows(F.col("text"), "stamp")).groupBy("work", F.col("text").alias("stamp")).agg(F.min("line_no").alias("first"), F.count(F.lit(1)).alias("alone"))

    def each(text: str, n: int, found: tuple[Patterns, dict[str, int]]) -> Iterable[tuple]:
        return () if text in found[1] else ((p,) for p in found[0].within(text) if n > found[1][p])  # a stamp alone is counted already

    begin = lambda rows: (Patterns(p for p, _ in rows), dict(rows))
    within = with_patterns(rows, own.select("work", F.col("stamp").alias("pattern"), "first"), each, "stamp string", begin)
    within = within.groupBy("work", "stamp").agg(F.count(F.lit(1)).alias("within"))
    n = F.col("alone") + F.coalesce("within", F.lit(0))
    return own.join(within, ["work", "stamp"], "left").select("work", "stamp", n.alias("n")).filter(F.col("n") >= least)


def address_marks(lines: DataFrame, least: int = ADDRESS_TIMES) -> DataFrame:
    """(work, mark, n): the first forty characters of the addresses that a work has `least` times or more."""
    found = F.regexp_extract_all("text", F.lit(r"\S*https?://\S+"), F.lit(0))
    mark = F.substring(F.regexp_extract("token", r"(http.*)", 1), 1, ADDRESS_MARK)
    rows = lines.filter(F.contains("text", F.lit("http"))).select("work", F.explode(found).alias("token")).groupBy("work", mark.alias("mark")).agg(F.count(F.lit(1)).alias("n"))
    return rows.filter(F.col("n") >= least)


def url_marks_removed(lines: DataFrame, least: int = ADDRESS_TIMES) -> DataFrame:
    """Lines without the addresses that return `least` times in a work, by their first forty characters."""

    def each(text: str, n: int, found: Patterns) -> Iterable[tuple]:
        yield (_without_addresses(text, found) if found.some else text,)

    return with_patterns(lines, address_marks(lines, least).select("work", F.col("mark").alias("pattern")), each, "text string")


def _without_addresses(text: str, marks: Patterns | set[str]) -> str:
    cut = ADDRESS.sub(lambda m: "" if m[0][m[0].index("http") :][:ADDRESS_MARK] in marks else m[0], text) if "http" in text else text
    return re.sub("[ \t]+$", "", re.sub("[ \t]{2,}", " ", cut))


def without_watermarks(lines: DataFrame) -> DataFrame:
    """Lines without the stamps and addresses that return in a work, numbered anew; works that have none stay as they are.

    A line that is a stamp becomes blank, a stamp or address within a line is cut out. Where addresses were found a line that begins anew with its own first twenty characters
    loses what stands before. Then lines of which only a mark is left go, and more than one blank line in a row becomes one.
    """
    marks = stamps(lines).select("work", F.concat(F.lit("s"), "stamp").alias("pattern")).union(address_marks(lines).select("work", F.concat(F.lit("a"), "mark")))

    def begin(rows: list[tuple]) -> tuple[Patterns, set[str]]:
        own = [p for (p,) in rows]
        return Patterns(p[1:] for p in own if p[0] == "s"), {p[1:] for p in own if p[0] == "a"}

    def each(text: str, n: int, found: tuple[Patterns, set[str]]) -> Iterable[tuple]:
        stamped, addresses = found
        if text.strip(T.BLANKS) in stamped:
            text = ""
        elif stamped.within(text):
            text = re.sub(r"\s{2,}", " ", stamped.cut_out(text, "")).strip(T.BLANKS)
        if addresses:
            text = begun_anew(_without_addresses(text, addresses))
        elif stamped.some:
            text = re.sub("[ \t]{2,}", " ", text)
        yield text, stamped.some or bool(addresses)

    rows = with_patterns(lines, marks, each, "text string, marked boolean", begin)
    rows = rows.filter(~F.col("marked") | ~F.trim("text").rlike(r"^(#|@|-)\s*$"))
    order = W.partitionBy("work").orderBy("line_no")
    blank = F.col("text") == ""
    rows = rows.withColumn("twice", F.col("marked") & blank & F.coalesce(F.lag(blank).over(order), F.lit(False))).filter("not twice")
    return rows.select("work", (F.row_number().over(order) - 1).alias("line_no"), "text")


def begun_anew(line: str) -> str:
    """A line from where it repeats its own first twenty characters; its mark stays."""
    mark, told = re.match(r"(\s*(?:# |@|- )?)(.*)", line, re.S).groups()
    told = told.rstrip()
    again = told.find(told[:HEAD], 1) if len(told) >= 2 * HEAD else -1
    return mark + told[again:] if again >= HEAD else line
