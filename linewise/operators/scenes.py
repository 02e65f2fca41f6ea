"""Raw scripts into scenes and marked text by rules, and the choice between two ways of doing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import shapes as S
from ..functions import text as T
from .lines import by_line, so_far, to_lines, to_text, with_segments
from .windows import reflow


def joined_scenes(lines: DataFrame, scene: str = "scene_no") -> DataFrame:
    """(work, scene_no, raw): the lines of each scene joined again."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    return lines.groupBy("work", F.col(scene).alias("scene_no")).agg(F.array_join(ordered, "\n").alias("raw"))


def renumbered(scenes: DataFrame) -> DataFrame:
    return scenes.withColumn("scene_no", F.row_number().over(W.partitionBy("work").orderBy("scene_no")) - 1)


def is_title_page(raw: Column) -> Column:
    """A piece of a script that is no scene: without a heading, and short or with the words of a title page."""
    full = F.filter(F.transform(F.split(raw, "\n"), T.trim), lambda x: x != "")
    headed = F.exists(full, lambda x: T.follows(x, "place at the start"))
    return ~headed & ((F.size(full) < 15) | F.exists(full, lambda x: T.follows(x, "title page")))


def scenes_by_headings(texts: DataFrame, work: str = "work", text: str = "text") -> DataFrame:
    """(work, scene_no, raw): a raw script cut before each line that opens a scene, without page marks and title pages.

    A script that would lose all its pieces as title pages keeps them; one without headings is one piece.
    """
    body = F.regexp_replace(F.regexp_replace(F.col(text), r"(?mi)^Page\s+\d+\/\d+\s*$", ""), r"(?m)^\s*\d+\.\s*$", "")
    lines = to_lines(texts.select(F.col(work).alias("work"), body.alias("text")), "work", "text")
    scenes = joined_scenes(with_segments(lines, S.opens_scene(F.col("text"))))
    whole = W.partitionBy("work")
    scenes = scenes.withColumn("title", is_title_page(F.col("raw"))).withColumn("all_titles", F.min(F.col("title").cast("int")).over(whole) == 1)
    return renumbered(scenes.filter(~F.col("title") | F.col("all_titles")).select("work", "scene_no", "raw"))


def scenes_at(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(work, scene_no, raw): the lines of a work cut before each line number of starts (work, line_no)."""
    marked = lines.join(starts.select("work", "line_no", F.lit(True).alias("starts")).distinct(), ["work", "line_no"], "left")
    return joined_scenes(with_segments(marked, F.coalesce("starts", F.lit(False))))


def rule_formatted(texts: DataFrame, work: str = "work", text: str = "text") -> DataFrame:
    """(work, formatted, confidence, headings, cues, body_lines): raw scripts marked by rules, and how far these can be trusted.

    Headings and speakers get their marks, a blank line goes where the indentation falls back from speech, broken sentences are joined. Confidence
    is 1, less 0.5 without a heading, 0.4 where the first line is none, and 0.4 where over eight lines of text have no speaker.
    """
    lines = to_lines(texts, work, text).withColumn("t", T.trim(F.col("text")))
    lines = lines.filter(~T.has(F.col("t"), r"^Page\s+\d+", True) & ~T.has(F.col("t"), r"^\d{1,4}\.?$"))
    full = F.col("t") != ""
    depth = lines.filter(full).withColumn("d", T.indent(F.col("text"))).groupBy("work", "d").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    depth = depth.groupBy("work").agg(F.max_by("d", F.struct("n", -F.col("first"))).alias("usual"), F.max("d").alias("deepest"))
    rows = lines.join(depth, "work", "left")
    deep = (F.col("deepest") >= F.col("usual") + 4) & (T.indent(F.col("text")) >= F.col("usual") + 4)
    rows = rows.withColumns({"heading": full & T.is_heading(F.col("t")), "deep": F.coalesce(deep, F.lit(False))})
    rows = rows.withColumn("cue", full & ~F.col("heading") & T.is_cue(F.col("t"))).withColumn("body", full & ~F.col("heading") & ~F.col("cue"))
    speech_before = F.coalesce(F.lag(F.col("cue") | (F.col("body") & F.col("deep"))).over(by_line()), F.lit(False))
    apart = F.col("body") & ~F.col("deep") & speech_before
    marked = F.when(F.col("heading"), T.normal_heading(F.col("t"))).when(F.col("cue"), T.as_cue(F.col("t"))).otherwise(F.col("t"))
    first = F.min(F.when(full, F.col("line_no"))).over(W.partitionBy("work"))
    rows = rows.withColumns({"out": marked, "apart": apart, "first_full": first})
    counts = rows.groupBy("work").agg(
        F.sum(F.col("heading").cast("int")).alias("headings"), F.sum(F.col("cue").cast("int")).alias("cues"), F.sum(F.col("body").cast("int")).alias("body_lines"),
        F.max((full & (F.col("line_no") == F.col("first_full")) & ~F.col("heading")).cast("int")).alias("late"),
    )
    less = lambda cond, by: F.when(cond, by).otherwise(0.0)
    confidence = F.lit(1.0) - less(F.col("headings") == 0, 0.5) - less(F.col("late") == 1, 0.4) - less((F.col("body_lines") > 8) & (F.col("cues") == 0), 0.4)
    counts = counts.withColumn("confidence", F.greatest(F.lit(0.0), F.round(confidence, 10)))
    parts = rows.select("work", "line_no", F.posexplode(F.when(F.col("apart"), F.array(F.lit(""), F.col("out"))).otherwise(F.array("out"))).alias("part", "text"))
    numbered = parts.select("work", (F.row_number().over(W.partitionBy("work").orderBy("line_no", "part")) - 1).alias("line_no"), "text")
    formatted = to_text(reflow(numbered)).withColumnRenamed("text", "formatted")
    return formatted.join(counts, "work").select("work", "formatted", "confidence", "headings", "cues", "body_lines")


def takes_new_extraction(old_cues: Column, new_cues: Column, least: int = 20) -> Column:
    """Whether a new extraction stands: one that has lost over 30 % of its speakers does not, unless there were few."""
    return (old_cues < least) | (new_cues >= old_cues * 0.7)


def takes_model_split(model_headed: Column, rule_headed: Column, raw_headings: Column) -> Column:
    """Whether a model's cut of a script stands against that by rules: as many headed scenes, and 80 % of the headings in the text."""
    return F.coalesce((model_headed >= rule_headed) & ((raw_headings == 0) | (model_headed >= raw_headings * 0.8)), F.lit(False))


def headed_scenes(scenes: DataFrame, raw: str = "raw") -> DataFrame:
    """(work, scenes, headed): how many scenes of a work start with what may be a heading."""
    first = F.try_element_at(F.filter(F.split(raw, "\n"), lambda x: ~T.is_blank(x)), F.lit(1))
    return scenes.groupBy("work").agg(F.count(F.lit(1)).alias("scenes"), F.sum(F.coalesce(S.is_likely_heading(first), F.lit(False)).cast("long")).alias("headed"))


def raw_headings(text: Column) -> Column:
    """Headings that a raw text has in plain sight."""
    return F.regexp_count(text, F.lit(r"(?mi)^[ \t]*(INT\.|EXT\.|I\/E\.)")) + F.regexp_count(text, F.lit(r"(?mi)^[ \t]*[A-Z]?\d+\.?\s+(INT\.|EXT\.)"))


def is_warning_scene(status: Column, aligned: Column, matches: Column) -> Column:
    """A scene to look at: failed, or with under 30 % of its subtitle matches aligned."""
    return status.startswith("error") | F.coalesce((matches > 0) & (aligned / F.nullif(matches, F.lit(0)) < 0.3), F.lit(False))
