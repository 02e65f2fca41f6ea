"""Operators on ordered lines of a work, as windows: no loop over lines anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from .lines import by_line, so_far, to_blocks, with_dialogue



def repeated_neighbours(lines: DataFrame) -> DataFrame:
    """Lines that equal the line before, blanks at the ends aside; a blank line between makes them different."""
    t = T.trim(F.col("text"))
    return lines.withColumn("t", t).withColumn("prev", F.lag("t").over(by_line())).filter((F.col("t") != "") & (F.col("t") == F.col("prev"))).drop("t", "prev")


def repeated_neighbours_in(texts: DataFrame, work: str, text: str, *keep: str) -> DataFrame:
    """(work, keep, line_no, text): the lines of repeated_neighbours, from whole texts: the lines of a text meet where it lies, so nothing is shuffled."""
    t = F.transform(F.split(F.col(text), "\n"), T.trim)
    before = F.concat(F.array(F.lit("")), F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))))
    again = F.zip_with(t, before, lambda a, b: F.when((a != "") & (a == b), a))
    rows = texts.filter(F.contains(F.col(text), F.lit("\n"))).select(F.col(work).alias("work"), *keep, F.posexplode(again).alias("line_no", "text"))
    return rows.filter(F.col("text").isNotNull())


def spacing_defects(lines: DataFrame) -> DataFrame:
    """Headings and cues that no blank line precedes."""
    rows = lines.withColumn("prev", F.lag(T.trim(F.col("text"))).over(by_line()))
    return rows.filter(T.has(T.trim(F.col("text")), "^[#@]") & F.col("prev").isNotNull() & (F.col("prev") != "")).drop("prev")


def reflow(lines: DataFrame) -> DataFrame:
    """Lines of a sentence that the page width broke, joined: (work, line_no of the first, text).

    A line joins the one before if both are body text, that one has no closing mark, and this one starts no list. Only two neighbouring
    lines decide, so runs of joining lines are islands.
    """
    t, last = F.col("t"), F.substring("t", -3, 3)  # for Java's engine two characters may end a text after its mark
    rows = lines.withColumn("t", T.trim(F.col("text"))).withColumn("body", (t != "") & ~T.has(t, "^[#@(-]"))
    rows = rows.withColumns({"open": F.col("body") & ~T.has(last, "[.!?…:;\"'’”)\\]]$"), "goes_on": F.col("body") & ~T.has(t, "^[-•*]")})
    joins = F.coalesce(F.lag("open").over(by_line()), F.lit(False)) & F.col("goes_on")
    rows = rows.withColumn("joins", joins).withColumn("island", F.sum((~F.col("joins")).cast("int")).over(so_far()))
    rows = rows.withColumn("joined_by_next", F.coalesce(F.lead("joins").over(by_line()), F.lit(False)))
    piece = F.when(F.col("joins"), F.col("t")).otherwise(F.when(F.col("joined_by_next"), T.rtrim(F.col("text"))).otherwise(F.col("text")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("p")))), lambda x: x["p"])
    return rows.groupBy("work", "island").agg(F.min("line_no").alias("line_no"), F.array_join(ordered, " ").alias("text"), F.count(F.lit(1)).alias("joined")).drop("island")


def normal_spacing(lines: DataFrame) -> DataFrame:
    """(work, line_no, text, gap): the non-blank lines without blanks at their ends, with gap where one blank line goes before them.

    Runs of blank lines become one; headings and cues have one before them; none is at the ends of a work.
    """
    rows = lines.withColumn("text", T.rtrim(F.col("text"))).filter(~T.is_blank(F.col("text")))
    last = F.lag("line_no").over(by_line())
    gap = last.isNotNull() & ((F.col("line_no") - last > 1) | T.has(T.trim(F.col("text")), "^[#@]"))
    return rows.withColumn("gap", F.coalesce(gap, F.lit(False)))


def spaced_text(lines: DataFrame) -> DataFrame:
    """(work, text): each work with normal spacing."""
    rows = normal_spacing(lines).withColumn("text", F.concat(F.when(F.col("gap"), "\n").otherwise(""), F.col("text")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return rows.groupBy("work").agg(F.array_join(ordered, "\n").alias("text"))


def missing_blank_after_dialogue(lines: DataFrame) -> DataFrame:
    """The lines after which dialogue runs into text that is none: at most one for each cue.

    In the stretch that a cue opens, it is the first said line whose next line is neither blank nor marked.
    """
    t = T.trim(F.col("text"))
    rows = lines.withColumn("t", t).withColumn("next", F.lead("t").over(by_line()))
    stop = F.col("t").startswith("@") | F.col("t").startswith("#") | (F.col("t") == "")
    rows = rows.withColumn("stretch", F.sum(stop.cast("int")).over(so_far())).withColumn("stop", stop)
    opened = F.first(F.col("t").startswith("@")).over(W.partitionBy("work", "stretch").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    hit = ~F.col("stop") & ~T.has(F.col("t"), r"^[(\[]") & F.col("next").isNotNull() & (F.col("next") != "") & ~T.has(F.col("next"), r"^(@|\(|#|\[|- )")
    rows = rows.withColumn("hit", opened & hit).filter("hit")
    return rows.withColumn("rn", F.row_number().over(W.partitionBy("work", "stretch").orderBy("line_no"))).filter("rn = 1").select("work", "line_no", "text")


def next_matching(value: Column, wanted: Column) -> Column:
    """The value of the next line that is wanted."""
    return F.first(F.when(wanted, value), ignorenulls=True).over(by_line().rowsBetween(1, W.unboundedFollowing))


def previous_matching(value: Column, wanted: Column) -> Column:
    return F.last(F.when(wanted, value), ignorenulls=True).over(by_line().rowsBetween(W.unboundedPreceding, -1))


def empty_cues(lines: DataFrame) -> DataFrame:
    """Cues whose next line, blank ones and parentheticals aside, is a cue, a heading, or none."""
    t = T.trim(F.col("text"))
    rows = lines.withColumn("t", t).withColumn("next", next_matching(F.col("t"), (F.col("t") != "") & ~F.col("t").startswith("(")))
    return rows.filter(F.col("t").startswith("@") & (F.col("next").isNull() | T.has(F.col("next"), "^[@#]"))).select("work", "line_no", "text")


def first_speech(lines: DataFrame, longest: int = 80) -> DataFrame:
    """(work, line_no, cue, speech): each cue with the line said first after it; cues that another cue or a heading follows are left out."""
    t = T.trim(F.col("text"))
    rows = lines.withColumn("t", t).withColumn("next", next_matching(F.col("t"), (F.col("t") != "") & ~F.col("t").startswith("(")))
    rows = rows.filter(F.col("t").startswith("@")).select("work", "line_no", T.cue_name(F.col("t")).alias("cue"), F.substring("next", 1, longest).alias("speech"))
    return rows.filter((F.col("cue") != "") & F.col("speech").isNotNull() & ~T.has(F.col("speech"), "^[@#]"))


def ghost_scenes(lines: DataFrame) -> DataFrame:
    """Headings that another heading follows, or nothing."""
    t = T.trim(F.col("text"))
    rows = lines.withColumn("t", t).filter(F.col("t") != "").withColumn("next", F.lead("t").over(by_line()))
    return rows.filter(F.col("t").startswith("#") & (F.col("next").isNull() | F.col("next").startswith("#"))).select("work", "line_no", "text")


def repeated_blocks(lines: DataFrame, least: int = 3) -> DataFrame:
    """(work, block_no, first_line, last_line): blocks that repeat the one before in a run of `least` or more; the first of a run is not among them.

    Blocks of one line of under 20 characters, as in a chorus, do not count.
    """
    blocks = in_runs(to_blocks(lines), W.partitionBy("work").orderBy("block_no"))
    return blocks.filter(is_repeat(least)).select("work", "block_no", "first_line", "last_line")


def in_runs(blocks: DataFrame, order) -> DataFrame:
    """All blocks with the length of the `run` of repeats that they are in and their place `rn` there; blocks that do not count are runs of their own."""
    counts = (F.size("lines") >= 2) | (F.length(T.sub(F.element_at("lines", 1), r"\s")) >= 20)
    new = ~(F.col("lines").eqNullSafe(F.lag("lines").over(order)) & counts)
    blocks = blocks.withColumn("island", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("work", "island").orderBy("block_no")
    # one order for both, also for the length, which needs none
    return blocks.withColumns({"run": F.count(F.lit(1)).over(run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "rn": F.row_number().over(run)})


def is_repeat(least: int = 3) -> Column:
    """Whether a block of in_runs is to go."""
    return (F.col("run") >= least) & (F.col("rn") > 1)


def close_repeated_cues(lines: DataFrame, within: int = 6) -> DataFrame:
    """Pairs of successive cues of one name at most `within` lines apart."""
    cues = lines.withColumn("cue", T.trim(F.col("text"))).filter(F.col("cue").startswith("@"))
    cues = cues.withColumn("next", F.lead("cue").over(by_line())).withColumn("next_line", F.lead("line_no").over(by_line()))
    return cues.filter((F.col("cue") == F.col("next")) & (F.col("next_line") - F.col("line_no") <= within)).select("work", "line_no", "next_line", "cue")


def trim_edges(lines: DataFrame, unwanted: Column | None = None) -> DataFrame:
    """Lines without the blank or unwanted ones (remarks, by default) at either end of a work; inner ones stay."""
    unwanted = T.is_meta(F.col("text")) if unwanted is None else unwanted
    content = ~T.is_blank(F.col("text")) & ~unwanted
    whole = W.partitionBy("work")
    rows = lines.withColumn("low", F.min(F.when(content, F.col("line_no"))).over(whole)).withColumn("high", F.max(F.when(content, F.col("line_no"))).over(whole))
    return rows.filter(F.col("line_no").between(F.col("low"), F.col("high"))).drop("low", "high")


def joined_headings(lines: DataFrame) -> DataFrame:
    """Headings that end in a dash joined with the headings after them: (work, line_no of the first, text)."""
    t = T.trim(F.col("text"))
    rows = lines.withColumn("t", t).withColumn("dangling", F.col("t").startswith("#") & T.has(F.col("t"), r"[-–—]\s*$"))
    joins = F.coalesce(F.lag("dangling").over(by_line()), F.lit(False)) & F.col("t").startswith("#")
    rows = rows.withColumn("joins", joins).withColumn("island", F.sum((~F.col("joins")).cast("int")).over(so_far()))
    piece = F.when(F.col("joins"), T.sub(F.col("t"), r"^#\s*[-–—]?\s*")).otherwise(F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("p")))), lambda x: x["p"])
    return rows.groupBy("work", "island").agg(F.min("line_no").alias("line_no"), F.array_join(ordered, " ").alias("text")).drop("island")


def previous_tail(scenes: DataFrame, lines: int = 3, longest: int = 220) -> DataFrame:
    """Scenes with `before`: the last non-empty lines of the scene before, for context."""
    full = F.filter(F.transform(F.split("scene", "\n"), T.trim), lambda x: x != "")
    tail = F.array_join(F.slice(full, F.greatest(F.size(full) - lines + 1, F.lit(1)), F.lit(lines)), " ")
    kept = F.substring(F.lag(tail).over(W.partitionBy("work").orderBy("scene_no")), -longest, longest)
    return scenes.withColumn("before", kept)


def logical_numbers(parts: DataFrame) -> DataFrame:
    """Parts with logical_no: continued parts have the number of the scene that they continue."""
    return parts.withColumn("logical_no", F.sum((~F.col("continued")).cast("int")).over(W.partitionBy("work").orderBy("part_no").rowsBetween(W.unboundedPreceding, 0)))


def context(lines: DataFrame, before: int = 2, after: int = 1) -> DataFrame:
    """The non-blank lines, each with arrays of the non-blank lines before and after it."""
    rows = lines.filter(~T.is_blank(F.col("text")))
    back, ahead = by_line().rowsBetween(-before, -1), by_line().rowsBetween(1, after)
    return rows.withColumn("before", F.collect_list("text").over(back)).withColumn("after", F.collect_list("text").over(ahead))


def y_lines(items: DataFrame, gap: float = 3.0) -> DataFrame:
    """(work, page, line_no, x, x2, y, text): positioned text items joined into lines where their heights differ by no more than `gap`."""
    order = W.partitionBy("work", "page").orderBy("seq")
    start = F.abs(F.col("y") - F.lag("y").over(order)) > gap
    rows = items.withColumn("line_no", F.sum(F.coalesce(start, F.lit(False)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "str"))), lambda x: x["str"])
    lines = rows.groupBy("work", "page", "line_no").agg(F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("x2"), F.min_by("y", "seq").alias("y"), F.array_join(ordered, "").alias("text"))
    return lines.filter(~T.is_blank(F.col("text")))


def without_overprint(items: DataFrame, within: float = 0.5) -> DataFrame:
    """Items without those that are drawn again where the same string just was."""
    order = W.partitionBy("work", "page").orderBy("seq")
    again = F.col("str").eqNullSafe(F.lag("str").over(order)) & (F.abs(F.col("x") - F.lag("x").over(order)) <= within) & (F.abs(F.col("y") - F.lag("y").over(order)) <= within)
    return items.withColumn("again", F.coalesce(again, F.lit(False))).filter("not again").drop("again")


def x_bands(lines: DataFrame, bucket: int = 5, gap: int = 14, share: float = 0.05) -> DataFrame:
    """(work, band, low, high, peak, n): the columns of text on the pages of a work.

    Left edges are counted in buckets; buckets no more than `gap` apart are one band, if it has a `share` of the lines; its
    peak is the fullest bucket, the leftmost of equals.
    """
    counts = lines.withColumn("edge", T.round_half_up(F.col("x") / bucket) * bucket).groupBy("work", "edge").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("work").orderBy("edge")
    counts = counts.withColumn("band", F.sum(F.coalesce(F.col("edge") - F.lag("edge").over(order) > gap, F.lit(False)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    bands = counts.groupBy("work", "band").agg(F.min("edge").alias("low"), F.max("edge").alias("high"), F.max_by("edge", F.struct("n", -F.col("edge"))).alias("peak"), F.sum("n").alias("n"))
    return bands.withColumn("all", F.sum("n").over(W.partitionBy("work"))).filter(F.col("n") >= share * F.col("all")).drop("all")


def dialogue_measures(lines: DataFrame) -> DataFrame:
    """(work, dialogue, action, action_words) from lines in and outside dialogue."""
    rows = with_dialogue(lines).filter("said")
    narrated = ~F.col("in_dialogue")
    return rows.groupBy("work").agg(
        F.sum(F.col("in_dialogue").cast("long")).alias("dialogue"), F.sum(narrated.cast("long")).alias("action"),
        F.coalesce(F.sum(F.when(narrated, T.word_count(F.col("text")))), F.lit(0)).cast("long").alias("action_words"),
    )
