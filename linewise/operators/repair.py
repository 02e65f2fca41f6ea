"""Repairs of marked texts and their translations: each takes lines and gives lines, or the rows that it is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P
from ..functions import shapes as S
from ..functions import text as T
from ..functions.rules import HEADERS, TRANSITION_SHAPE
from .align import align_markers
from .lines import by_line, so_far
from .names import stamps, url_marks_removed  # noqa: F401  (repairs by the patterns of a work)
from .windows import next_matching

#: Fixed value: words by which prose is known to be English.
ENGLISH_WORDS = (
    r"\b(the|and|is|are|was|were|to|of|in|on|at|it|he|she|they|you|with|for|that|this|his|her|from|but|not|have|has|had|will|would|can|be|as|by|we|a|an|into|out|up|down"
    r"|then|now|still|like|all|no|back|over|off|through|after|before)\b"
)


def _renumbered(rows: DataFrame, *order: str) -> DataFrame:
    return rows.withColumn("line_no", (F.row_number().over(W.partitionBy("work").orderBy(*order)) - 1).cast("int"))


def distinct_in_order(rows: DataFrame, value: str, order: str = "line_no") -> DataFrame:
    """(work, value, first): each value once, with where it first stands."""
    return rows.groupBy("work", value).agg(F.min(order).alias("first"))


def trailing_actions(blocks: DataFrame) -> DataFrame:
    """(work, block_no, part, type, text): speech blocks cut before their first line of narration; others as they are.

    A block that starts with narration stays whole.
    """
    ls = F.split("text", "\n")
    at = F.array_position(F.transform(ls, lambda x: S.is_english_narration(x)), F.lit(True))
    cut = (F.col("type") == "dialogue") & (at > 1)
    said, told = F.array_join(F.slice(ls, F.lit(1), at - 1), "\n"), F.array_join(F.slice(ls, at, F.size(ls)), "\n")
    piece = lambda kind, text: F.struct(F.lit(kind).alias("type"), T.trim(text).alias("text"))
    parts = F.when(cut, F.filter(F.array(piece("dialogue", said), piece("action", told)), lambda p: p["text"] != "")).otherwise(F.array(F.struct("type", "text")))
    return blocks.select("work", "block_no", F.posexplode(parts).alias("part", "p")).select("work", "block_no", "part", "p.type", "p.text")


def caption_blocks(lines: DataFrame) -> DataFrame:
    """(work, block_no, type, text): credits and captions, from their mark to a line that ends in a bracket, and the plain text between them."""
    start = T.has(F.col("text"), r"^\s*\[(크레딧|자막)\s*:")
    ends = T.has(F.col("text"), r"\]\s*$")
    rows = lines.withColumns({"starts": start, "ends": ends})
    # a line is within a caption if none of those since the last mark has ended it; a mark within a caption is none of its own
    rows = rows.withColumn("closed", F.sum(F.col("ends").cast("int")).over(by_line().rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("stretch", F.coalesce("closed", F.lit(0)))
    part = W.partitionBy("work", "stretch").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.max(F.col("starts").cast("int")).over(part) == 1)
    rows = rows.withColumn("mark", F.first(F.when(F.col("starts"), F.regexp_extract("text", r"^\s*\[(크레딧|자막)", 1)), ignorenulls=True).over(part))
    new = F.col("inside") & ~F.coalesce(F.lag("inside").over(W.partitionBy("work", "stretch").orderBy("line_no")), F.lit(False))
    same = F.lag("inside").over(by_line()).eqNullSafe(F.col("inside")) & ~new
    rows = rows.withColumn("block_no", F.sum((~same).cast("int")).over(so_far()) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    out = rows.groupBy("work", "block_no").agg(F.coalesce(F.first("mark"), F.lit("plain")).alias("type"), joined.alias("text"), F.max("inside").alias("inside"))
    bare = T.trim(T.sub(T.sub(F.col("text"), r"^\s*\[(크레딧|자막)\s*:\s*"), r"\]\s*$"))
    return out.select("work", "block_no", "type", F.when(F.col("inside"), bare).otherwise(F.col("text")).alias("text"))


def english_doubles(lines: DataFrame) -> DataFrame:
    """English lines that their Korean version follows: headings and cues before one of their kind, and prose before Korean prose."""
    t = T.trim(F.col("text"))
    rows = lines.withColumn("t", t).withColumn("next", next_matching(F.col("t"), F.col("t") != ""))
    structural = lambda x: T.has(x, r"^[#@(]|^-\s")
    english, korean = ~T.has(F.col("t"), "[가-힣]"), T.has(F.col("next"), "[가-힣]")
    marked = T.has(F.col("t"), "^[#@]") & english & (T.latin(F.col("t")) >= 3) & korean & (F.substring("next", 1, 1) == F.substring("t", 1, 1))
    prose = (F.length("t") >= 25) & english & ~structural(F.col("t")) & (T.latin(F.col("t")) >= 20) & T.has(F.col("t"), ENGLISH_WORDS, True)
    prose = prose & korean & ~structural(F.col("next")) & (F.length("next") >= 15)
    return rows.filter(marked | prose).select("work", "line_no", "text")


def without_doubles(lines: DataFrame) -> DataFrame:
    """Lines without english_doubles and the blank line after each; numbered anew."""
    gone = english_doubles(lines).select("work", "line_no", F.lit(True).alias("gone"))
    rows = lines.join(gone, ["work", "line_no"], "left")
    after = F.coalesce(F.lag("gone").over(by_line()), F.lit(False)) & T.is_blank(F.col("text"))
    return _renumbered(rows.withColumn("after", after).filter(F.col("gone").isNull() & ~F.col("after")).select("work", "line_no", "text"), "line_no")


def demoted_cues(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Lines whose cues that a reader has marked (work, name) have lost their mark."""
    t = T.trim(F.col("text"))
    name = F.when(t.startswith("@"), T.trim(T.sub(F.substring(t, 2, 1 << 30), r"\s*\(.*\)\s*$")))
    marked = names.select("work", "name", F.lit(True).alias("demoted")).distinct()
    rows = lines.withColumn("name", name).join(marked, ["work", "name"], "left")
    return rows.select("work", "line_no", F.when(F.col("demoted"), T.sub(F.col("text"), r"^(\s*)@\s*", "$1")).otherwise(F.col("text")).alias("text"))


def trapped_cues(lines: DataFrame) -> DataFrame:
    """Lines whose short names in brackets, with speech after them, are cues again where an old rule took them for transitions."""
    name = T.trim(F.regexp_extract(T.trim(F.col("text")), r"^\((.{1,30})\)$", 1))
    rows = lines.withColumn("name", name).withColumn("t", T.trim(F.col("text"))).withColumn("next", next_matching(F.col("t"), F.col("t") != ""))
    shape = T.has(F.col("name"), TRANSITION_SHAPE, True) & ~S.is_transition(F.col("name")) & T.capitals(F.col("name"), 2, 0.9)
    fixed = F.when((F.col("name") != "") & shape & F.col("next").startswith("- "), F.concat(F.lit("@"), "name")).otherwise(F.col("text"))
    return rows.select("work", "line_no", fixed.alias("text"))


def without_script_headers(lines: DataFrame) -> DataFrame:
    """Lines without the headers of revised pages that stand in them; a line of which only a mark is left goes, and runs of blank lines become one.

    Only lines that hold such a header are looked at pattern by pattern.
    """
    rows = lines.withColumn("bare", P.replaced(F.col("text"), HEADERS))
    bare = T.rtrim(T.sub(F.regexp_replace("bare", r"[ \t]{2,}", " "), r"\s+([,.!?…])", "$1"))
    rows = rows.select("work", "line_no", F.col("bare").isNotNull().alias("hit"), F.coalesce(bare, F.col("text")).alias("text"))
    rows = rows.filter(~F.col("hit") | (T.trim(T.sub(F.col("text"), r"^[-#@\s]+")) != ""))
    twice = T.is_blank(F.col("text")) & F.coalesce(F.lag(T.is_blank(F.col("text"))).over(by_line()), F.lit(False))
    return _renumbered(rows.withColumn("twice", twice).filter("not twice").select("work", "line_no", "text"), "line_no")


def without_echo(lines: DataFrame) -> DataFrame:
    """Lines without the labels of the task and blank lines that an answer starts with, and the fences and blank lines that it ends with."""
    t = T.trim(F.col("text"))
    head = ~((t == "") | T.follows(t, "echoed label"))
    tail = ~((t == "") | T.has(t, "^```$"))
    whole = W.partitionBy("work")
    rows = lines.withColumn("low", F.min(F.when(head, F.col("line_no"))).over(whole)).withColumn("high", F.max(F.when(tail, F.col("line_no"))).over(whole))
    return rows.filter(F.col("line_no").between(F.col("low"), F.col("high"))).drop("low", "high")


def without_restarts(lines: DataFrame) -> DataFrame:
    """Lines without what a model wrote before it said that it starts anew: from the start of the scene through the notice."""
    rows = lines.withColumn("scene", F.sum(F.col("text").startswith("# ").cast("int")).over(so_far()))
    rows = rows.withColumn("notice", F.max(F.when(T.follows(T.trim(F.col("text")), "self correction"), F.col("line_no"))).over(W.partitionBy("work", "scene")))
    return rows.filter(F.col("notice").isNull() | (F.col("line_no") > F.col("notice"))).drop("scene", "notice")


def without_empty_headings(lines: DataFrame) -> DataFrame:
    """Lines without headings that say nothing and explanations of why nothing was done."""
    t = T.trim(F.col("text"))
    return lines.filter(~T.follows(t, "empty heading") & ~T.follows(t, "explanation"))


def cleaned_reading(lines: DataFrame) -> DataFrame:
    """Lines of a bad reading without garbage, signs before their first word, and signs before names."""
    cue, blank = F.col("text").startswith("@"), T.is_blank(F.col("text"))
    bare = F.when(cue, S.clean_cue(F.col("text"))).otherwise(S.without_lead_junk(F.col("text")))
    return lines.filter(cue | blank | (~S.is_garbage(F.col("text")) & ~T.is_blank(bare))).withColumn("text", F.when(blank, F.col("text")).otherwise(bare))


def found_works(notes: DataFrame, works: DataFrame) -> DataFrame:
    """notes (id, ...) with the work of that id, or else the first whose id differs in case alone; works have (work)."""
    named = works.select("work", F.lower("work").alias("key"))
    both = notes.select("id").distinct().join(named, F.lower("id") == F.col("key"))
    best = both.groupBy("id").agg(F.min_by("work", F.struct(F.col("work") != F.col("id"), "work")).alias("work"))
    return notes.join(best, "id")


def patched(lines: DataFrame, patches: DataFrame) -> DataFrame:
    """Lines with stretches (work, first_line, last_line, text) replaced by other text; numbered anew. Stretches do not overlap."""
    p = patches.select(F.col("work").alias("p_work"), "first_line", "last_line", F.col("text").alias("new"))
    rows = lines.join(p, (F.col("work") == F.col("p_work")) & F.col("line_no").between(F.col("first_line"), F.col("last_line")), "left")
    rows = rows.filter(F.col("first_line").isNull() | (F.col("line_no") == F.col("first_line")))
    parts = rows.select("work", "line_no", F.posexplode(F.split(F.coalesce("new", "text"), "\n")).alias("part", "text"))
    return _renumbered(parts, "line_no", "part").select("work", "line_no", "text")


ANCHORS = ("scene", "character", "paren")


def realigned(source: DataFrame, result: DataFrame) -> DataFrame:
    """(work, block_no, type, source, result): the blocks of a source, each beside the block of its translation, or null; both have (work, block_no, type, text).

    Headings, cues and parentheticals are paired by a longest common subsequence of their types; those of the translation that have no pair go, with what
    follows them. Blocks between two of them go together in order: E blocks of the source cut the K blocks of the translation at the rounded multiples of K / E,
    and each gets one block at least while there are some left, so neighbours are joined or shared. Without blocks of the source they join the heading or cue before.
    """
    marks = lambda b: b.filter(F.col("type").isin(*ANCHORS))
    paired = align_markers(marks(source), marks(result))

    def with_anchor(blocks: DataFrame) -> DataFrame:
        """Each block with the last anchor at or before it, -1 before the first."""
        at = F.last(F.when(F.col("type").isin(*ANCHORS), F.col("block_no")), ignorenulls=True).over(W.partitionBy("work").orderBy("block_no").rowsBetween(W.unboundedPreceding, 0))
        return blocks.withColumn("anchor", F.coalesce(at, F.lit(-1)).cast("long"))

    order = W.partitionBy("work", "anchor").orderBy("block_no")
    s = with_anchor(source).withColumn("nth", F.row_number().over(order) - F.when(F.col("anchor") >= 0, 2).otherwise(1))
    s = s.withColumn("e", F.max("nth").over(W.partitionBy("work", "anchor")) + 1)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"])
    r = with_anchor(result).groupBy("work", F.col("anchor").alias("b")).agg(texts.alias("texts"))
    ends = paired.union(source.select("work").distinct().select("work", F.lit(-1).cast("long"), F.lit(-1).cast("long")))
    own = F.col("b") >= 0  # the anchor itself is the first text
    r = r.join(ends, ["work", "b"]).withColumn("head", F.when(own, F.col("texts")[0])).withColumn("texts", F.when(own, F.expr("slice(texts, 2, size(texts))")).otherwise(F.col("texts")))
    rows = s.join(r.select("work", F.col("a").alias("anchor"), "head", "texts"), ["work", "anchor"], "left")
    cut = lambda g: F.floor(g * (F.size("texts") / F.col("e")) + 0.5)
    first, end = cut(F.col("nth")), cut(F.col("nth") + 1)
    share = F.when(F.size("texts") > 0, F.array_join(F.slice("texts", (first + 1).cast("int"), (F.greatest(end, first + 1) - first).cast("int")), " "))
    found = F.when(F.col("nth") >= 0, share).when(F.col("e") == 0, F.array_join(F.concat(F.array("head"), "texts"), " ")).otherwise(F.col("head"))
    return rows.select("work", "block_no", "type", F.col("text").alias("source"), found.alias("result"))


def gaps(aligned: DataFrame) -> DataFrame:
    """The aligned blocks that have no translation yet; speakers need none."""
    return aligned.filter((F.col("type") != "character") & S.needs_translation(F.col("source"), F.col("result")))


def first_versions(paths: Column, known: Column) -> Column:
    """Where a text is put aside before it is first changed: beside it, unless that was done before."""
    return F.when(~F.coalesce(known, F.lit(False)), F.concat(paths, F.lit(".before")))
