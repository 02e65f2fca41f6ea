"""Positioned text into lines, columns and typed blocks. Items have (work, page, seq, str, x, y, width); lines (work, page, line_no, x, x2, y, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import shapes as S
from ..functions import text as T
from ..functions.rules import RULES
from .builders import IndentBuilder, PageBuilder, built, flags

#: Headings with a number, alone on a line or with the narration after it.
NUMBERED_HEAD = r"^(\d{1,3}[A-Za-z]?\.\s+)([A-Z][A-Z0-9 ,.'’\/&()-]{4,})$"
NUMBERED_SPLIT = r"^(\d{1,3}[A-Za-z]?\.\s+)([A-Z][A-Z0-9 ,.'’\/&()-]{4,}?)(?=\s+[A-Z][a-z])"
ROMAN = r"^(?=[ivxlcdm])m*(c[md]|d?c{0,3})(x[cl]|l?x{0,3})(i[xv]|v?i{0,3})\.$"
EUROPEAN_SCENE = r"^\d{1,3}[A-Za-z]?\s*[-–—]\s*.+(?:(?:INT|EXT)(?![a-zA-Zà-ÿÀ-ÖØ-öø-ÿ])|I[-+]E(?![a-zA-Zà-ÿÀ-ÖØ-öø-ÿ])|E[-+]I(?![a-zA-Zà-ÿÀ-ÖØ-öø-ÿ]))"


def nearest_rank(rows: DataFrame, value: Column, share: float, name: str, by: str = "work") -> DataFrame:
    """(by, name): the value at place min(n - 1, floor(n x share)) of the values in order, from 0.

    Values are counted first, so a work with many equal ones is few rows.
    """
    counts = rows.select(by, value.alias("v")).filter("v is not null").groupBy(by, "v").agg(F.count(F.lit(1)).alias("c"))
    up, whole = W.partitionBy(by).orderBy("v"), W.partitionBy(by)
    counts = counts.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(whole))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * share))
    return counts.filter(F.col("upto") > at).groupBy(by).agg(F.min("v").alias(name))


def rows_by_height(items: DataFrame, keep_blank: bool = False) -> DataFrame:
    """(work, page, y, x, text): items of one rounded height as a line, from left to right; blank items and the lines they leave empty go unless kept."""
    rows = (items if keep_blank else items.filter(~T.is_blank(F.col("str")))).withColumn("row", T.round_half_up(F.col("y")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("x", "seq", "str"))), lambda i: i["str"])
    lines = rows.groupBy("work", "page", "row").agg(T.round_half_up(F.min("x")).alias("x"), T.trim(T.sub(F.array_join(ordered, ""), r"\s+", " ")).alias("text"))
    return (lines if keep_blank else lines.filter("text <> ''")).select("work", "page", F.col("row").alias("y"), "x", "text")


def layer_kinds(pages: DataFrame) -> DataFrame:
    """(work, pages, per_page, image_pages, verdict): what the text of a file comes from, judged by three of its pages; pages have (work, page, items, image, fonts).

    `none` with under five items a page, `read` where a font says that it was, `scan` where six in ten of the pages are images, else `text`.
    """
    counted = pages.withColumn("n", F.max("page").over(W.partitionBy("work")))
    probe = F.array_distinct(F.array(F.lit(2), F.ceil(F.col("n") * 0.35).cast("int"), F.ceil(F.col("n") * 0.7).cast("int")))
    rows = counted.filter(F.array_contains(probe, F.col("page").cast("int"))).groupBy("work").agg(
        F.max("n").alias("pages"), T.round_half_up(F.sum("items") / F.count(F.lit(1))).alias("per_page"), F.sum(F.col("image").cast("int")).alias("image_pages"),
        F.count(F.lit(1)).alias("looked_at"), F.max(F.exists("fonts", lambda f: T.has(f, "glyphless|invisible|ocr", True)).cast("int")).alias("read"),
    )
    verdict = F.when(F.col("per_page") < 5, "none").when(F.col("read") == 1, "read").when(F.col("image_pages") / F.col("looked_at") >= 0.6, "scan").otherwise("text")
    return rows.select("work", "pages", "per_page", "image_pages", verdict.alias("verdict"))


def without_margin_numbers(items: DataFrame) -> DataFrame:
    """Items without the scene numbers in the margins: number tokens left of all words, or right of where 99 % of the words start."""
    words = items.filter(T.has(F.col("str"), "[A-Za-z]{4,}"))
    edges = words.groupBy("work").agg(F.min("x").alias("left")).join(nearest_rank(words, F.col("x"), 0.99, "right"), "work")
    rows = items.join(edges, "work", "left")
    outside = (F.col("x") < F.coalesce("left", F.lit(0.0)) - 10) | (F.col("x") > F.col("right") + 20)
    return rows.filter(~(T.follows(F.col("str"), "margin number") & F.coalesce(outside, F.lit(False)))).drop("left", "right")


def page_headers(lines: DataFrame, depth: int = 2, share: float = 0.3, shortest: int = 8) -> DataFrame:
    """(work, key, loose, n): texts, with and without a number at their end, that return at the edges of pages: max(3, share of the pages) times."""
    edge = _edges(lines, depth).filter("edge")
    keys = F.array(F.struct(_squeezed(F.col("text")).alias("key"), F.lit(False).alias("loose")), F.struct(S.loose_key(F.col("text")).alias("key"), F.lit(True).alias("loose")))
    counts = edge.select("work", F.explode(keys).alias("k")).select("work", "k.key", "k.loose").filter(F.length("key") >= shortest).groupBy("work", "key", "loose").agg(F.count(F.lit(1)).alias("n"))
    pages = lines.groupBy("work").agg(F.max("page").alias("pages"))
    return counts.join(pages, "work").filter(F.col("n") >= F.greatest(F.lit(3), F.floor(F.greatest("pages", F.lit(1)) * share))).select("work", "key", "loose", "n")


def _squeezed(text: Column) -> Column:
    return T.trim(T.sub(text, r"\s+", " "))


def _edges(lines: DataFrame, depth: int) -> DataFrame:
    down, up = W.partitionBy("work", "page").orderBy("line_no"), W.partitionBy("work", "page").orderBy(F.desc("line_no"))
    return lines.withColumn("edge", (F.row_number().over(down) <= depth) | (F.row_number().over(up) <= depth))


def without_page_headers(lines: DataFrame, depth: int = 2, longest_kept: int = 20, **options) -> DataFrame:
    """Lines without page_headers; long ones are also cut out of the lines at the edges that hold them."""
    headers = page_headers(lines, depth, **options)
    exact = F.collect_list(F.when(~F.col("loose"), F.col("key")))
    sets = headers.groupBy("work").agg(exact.alias("exact"), F.collect_list(F.when(F.col("loose"), F.col("key"))).alias("loosely"))  # few a work
    rows = _edges(lines, depth).join(sets, "work", "left")
    gone = F.col("edge") & (F.array_contains("exact", _squeezed(F.col("text"))) | F.array_contains("loosely", S.loose_key(F.col("text"))))
    cut = F.aggregate(F.filter("exact", lambda k: F.length(k) >= longest_kept), F.col("text"), lambda acc, k: F.when(F.contains(acc, k), _squeezed(F.replace(acc, k, F.lit(" ")))).otherwise(acc))
    rows = rows.filter(~F.coalesce(gone, F.lit(False))).withColumn("text", F.when(F.col("edge") & F.col("exact").isNotNull(), cut).otherwise(F.col("text")))
    return rows.filter(~T.is_blank(F.col("text"))).drop("edge", "exact", "loosely")


def bands(lines: DataFrame) -> DataFrame:
    """(work, x_action, dialogue, character, transition): where the columns of a script start, from how often lines start at each place.

    Places are rounded to five points. Where five lines or more that name speakers start at one place, that is the speakers' column; narration is the
    leftmost column left of it with a twentieth of the lines, speech the fullest one between. Else narration is the leftmost of the three fullest places.
    """
    rows = lines.select("work", (T.round_half_up(F.col("x") / 5) * 5).alias("x"), S.is_page_cue(F.col("text")).cast("int").alias("cue"))
    counts = rows.groupBy("work", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("cue").alias("cues"))
    whole = W.partitionBy("work")
    counts = counts.withColumn("all", F.sum("n").over(whole)).withColumn("rank", F.row_number().over(whole.orderBy(F.desc("n"), "x")))
    speakers = counts.filter("cues > 0").groupBy("work").agg(F.max_by(F.struct("x", "cues"), F.struct("cues", -F.col("x"))).alias("s"))
    fullest = counts.filter("rank <= 3").groupBy("work").agg(F.min("x").alias("leftmost"))
    placed = counts.join(speakers, "work", "left").withColumn("x_char", F.when(F.col("s.cues") >= 5, F.col("s.x")))
    noise = F.greatest(F.lit(3.0), F.col("all") * 0.003)
    columns = lambda inside: _clumps(placed.filter(F.col("x_char").isNotNull() & inside & (F.col("n") >= noise)))
    left = columns(F.col("x") < F.col("x_char") - 50)
    solid = F.min(F.when(F.col("n") >= F.col("all") * 0.05, F.col("peak")))
    left = left.withColumn("rank", F.row_number().over(W.partitionBy("work").orderBy(F.desc("n"), "low")))
    action = left.groupBy("work").agg(F.coalesce(solid, F.min(F.when(F.col("rank") <= 3, F.col("peak")))).alias("found"))
    frame = fullest.join(placed.groupBy("work").agg(F.max("x_char").alias("x_char")), "work").join(action, "work", "left")
    frame = frame.withColumn("x_action", F.when(F.col("x_char").isNull(), F.col("leftmost")).otherwise(F.coalesce("found", F.col("x_char") - 220)))
    between = placed.join(frame.select("work", "x_action"), "work").filter((F.col("x") >= F.col("x_action") + 40) & (F.col("x") < F.col("x_char") - 20) & (F.col("n") >= noise))
    middle = _clumps(between).filter("n >= 20").groupBy("work").agg(F.max_by("peak", F.struct("n", -F.col("low"))).alias("speech"))
    half = T.round_half_up((F.col("x_action") + F.col("x_char") - 20) / 2)
    dialogue = F.when(F.col("x_char").isNull(), F.col("x_action") + 50).otherwise(F.least(F.coalesce(F.col("speech") - 8, half), half))
    none = F.col("x_char").isNull()
    return frame.join(middle, "work", "left").select(
        "work", "x_action", dialogue.alias("dialogue"), F.when(none, F.col("x_action") + 110).otherwise(F.col("x_char") - 20).alias("character"),
        F.when(none, F.col("x_action") + 320).otherwise(F.col("x_char") + 300).alias("transition"),
    )


def _clumps(places: DataFrame, gap: int = 14) -> DataFrame:
    """(work, low, peak, n, all): places no more than `gap` apart as one; its peak is the fullest of them, the leftmost of equals."""
    order = W.partitionBy("work").orderBy("x")
    apart = F.coalesce(F.col("x") - F.lag("x").over(order) > gap, F.lit(False))
    rows = places.withColumn("clump", F.sum(apart.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("work", "clump").agg(F.min("x").alias("low"), F.max_by("x", F.struct("n", -F.col("x"))).alias("peak"), F.sum("n").alias("n"), F.max("all").alias("all"))


def page_types(lines: DataFrame, columns: DataFrame) -> DataFrame:
    """Lines with type: scene, transition, character, paren, dialogue or action, by their shape first and then by the column they start in."""
    rows = lines.join(columns.select("work", "dialogue", "character", "transition"), "work")
    t, x = T.trim(F.col("text")), F.col("x")
    kind = (
        F.when(S.is_page_heading(t), "scene").when(S.is_transition(t) | (x >= F.col("transition")), "transition").when((x >= F.col("character")) & S.is_page_cue(t), "character")
        .when(T.has(t, r"^\(.*\)$"), "paren").when((x >= F.col("dialogue")) & (x < F.col("character")), "dialogue").otherwise("action")
    )
    return rows.withColumn("type", kind)


def page_heading_text(text: Column) -> Column:
    """A heading without its mark and the scene numbers at its ends."""
    h = T.sub(T.sub(T.trim(text), r"^#\s*"), r"^[A-Z]{0,2}\d+[A-Z]?\.?\s+")
    return T.trim(T.sub(T.sub(h, r"\s+[A-Z]{1,2}\d+[A-Z]?\.?\*?$"), r"\s*\d+[A-Z]?\.?\*?$"))


def page_blocks(lines: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(work, block_no, type, text): the typed blocks of a script in positioned lines, ready to be rendered.

    Furniture goes. A line of narration right after a speaker, remarks in brackets aside, is speech. Lines of one type are one block while
    they follow each other on a page without a gap of over 1.7 lines; before the first scene also while they fill their column. A
    speaker at the end of a page whose next line is no speech is a leftover. Headings that end in a dash go on in the next. What comes before the first
    scene is a title page, of which cards and transitions stay, if it is no more than 40 blocks and a twentieth of all.

    The lines of a work go through one ordered pass, with one shuffle (builders.PageBuilder); columns may be given, as bands() has them.
    """
    t = T.trim(F.col("text"))
    alone, split = T.has(t, NUMBERED_HEAD), t.rlike(T.rx(NUMBERED_SPLIT))
    title = lambda pattern: T.sub(T.trim(F.regexp_extract(t, T.rx(pattern), 2)), r"[.,\s]+$")
    roman = (F.col("page") <= 8) & t.rlike(ROMAN)
    given = ("dialogue", "character", "transition")
    rows = lines.join(columns.select("work", *given), "work") if columns is not None else lines.withColumns({c: F.lit(None).cast("double") for c in given})
    rows = rows.select(
        "work", "page", "line_no", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *(F.col(c).cast("double").alias(c) for c in given), t.alias("t"), F.length("text").alias("length"),
        page_heading_text(t).alias("heading_text"), F.when(alone, title(NUMBERED_HEAD)).when(split, title(NUMBERED_SPLIT)).alias("number_head"),
        F.when(~alone & split, T.trim(F.regexp_replace(t, T.rx(NUMBERED_SPLIT), ""))).alias("number_rest"),
        *flags(heading=S.is_page_heading(t), change=S.is_transition(t), cue=S.is_page_cue(t), paren=T.has(t, r"^\(.*\)$"), skipped=F.coalesce(t == "", F.lit(True)) | T.follows(t, "page furniture") | roman),
    )
    return built(rows, PageBuilder, "page", "line_no")


def without_title_page(blocks: DataFrame, most: int = 40, share: float = 0.05, shortest: int = 0) -> DataFrame:
    """Blocks without what stands before the first scene, cards, transitions and other prose aside; a first scene that comes late cuts nothing."""
    whole = W.partitionBy("work")
    rows = blocks.withColumn("first", F.min(F.when(F.col("type") == "scene", F.col("block_no"))).over(whole)).withColumn("n", F.count(F.lit(1)).over(whole))
    t = T.trim(T.sub(F.col("text"), r"^[-@#]\s*"))
    prose = (F.col("type") == "action") & (t != "") & (T.follows(t, "title card") | (~T.follows(t, "title page text") & (F.length(t) >= shortest)))
    keep = (F.col("type") == "transition") | prose
    limit = F.least(F.lit(most), F.floor(F.col("n") * share)) if share < 1 else F.col("n")
    cut = F.coalesce((F.col("first") > 0) & (F.col("first") <= limit) & (F.col("block_no") < F.col("first")), F.lit(False))
    kept = rows.filter(~cut | keep).drop("first", "n")
    return kept.withColumn("block_no", F.row_number().over(W.partitionBy("work").orderBy("block_no")) - 1)


def indented_blocks(lines: DataFrame) -> DataFrame:
    """(work, block_no, type, text): the typed blocks of a script whose indentation stands for columns; lines have (work, line_no, text).

    Speakers start where a quarter of twenty or more lines that name some do, or at 30 blanks; speech starts at 0.45 of that. A line after a speaker is
    speech, and so is one that starts within two blanks of the last speech. One ordered pass, with one shuffle (builders.IndentBuilder).
    """
    t = F.coalesce(T.trim(F.col("text")), F.lit(""))
    skipped = T.has(t, r"^\*?\s*[A-Z]{0,2}\d{1,4}[A-Z]?\.?\*?$") | T.has(t, r"^\(?(CONTINUED|CONT'D|MORE)\)?\s*:?\s*(\(\d+\))?\s*\d{0,4}[A-Za-z]?\.?$", True)
    heading = T.has(t, RULES["page heading"].some[0][4:], True) | T.is_slug_line(t, S.TIMES_ON_PAGES, False, 1)
    marks = flags(heading=heading, change=S.is_transition(t), cue=S.is_page_cue(t), paren=T.has(t, r"^\(.*\)$"), skipped=skipped)
    rows = lines.select("work", "line_no", t.alias("t"), F.coalesce(T.indent(F.col("text")), F.lit(0)).alias("ind"), page_heading_text(t).alias("heading_text"), *marks)
    return built(rows, IndentBuilder, "line_no")


def european_lines(rows: DataFrame, tolerance: int = 12) -> DataFrame:
    """(work, line_no, type, text): scripts in two columns, narration and speech with its speakers; rows are those of rows_by_height.

    Columns are the two leftmost places where a twentieth of the lines start. A line with a scene's number and no place goes on in up to two lines after
    it, if these give it one. Works without two columns give nothing.
    """
    whole = W.partitionBy("work")
    counts = rows.groupBy("work", "x").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(whole)).filter(F.col("n") >= F.col("all") * 0.05)
    places = counts.withColumn("rank", F.row_number().over(whole.orderBy("x"))).groupBy("work").agg(F.min("x").alias("left"), F.min(F.when(F.col("rank") == 2, F.col("x"))).alias("right")).filter("right is not null")
    at = F.row_number().over(whole.orderBy("page", F.desc("y")))
    near = lambda c: F.abs(F.col("x") - F.col(c)) <= tolerance
    lines = rows.join(places, "work").filter(near("left") | near("right")).withColumn("line_no", at).withColumn("told", near("left"))
    order = whole.orderBy("line_no")
    more = lambda k: F.when(F.lead("told", k).over(order), F.lead("text", k).over(order))
    lines = lines.withColumns({"one": F.concat_ws(" ", "text", more(1)), "has_one": more(1).isNotNull(), "two": F.concat_ws(" ", "text", more(1), more(2)), "has_two": more(1).isNotNull() & more(2).isNotNull()})
    scene = lambda c: F.col(c).rlike("(?i)" + EUROPEAN_SCENE)
    starts = F.col("told") & T.has(F.col("text"), r"^\d{1,3}[A-Za-z]?\s*[-–—]") & ~scene("text")
    took = F.when(starts & F.col("has_one") & scene("one"), 1).when(starts & F.col("has_two") & scene("two"), 2).otherwise(0)
    lines = lines.withColumn("took", took)
    eaten = (F.coalesce(F.lag("took", 1).over(order), F.lit(0)) >= 1) | (F.coalesce(F.lag("took", 2).over(order), F.lit(0)) >= 2)
    lines = lines.withColumn("eaten", eaten).filter("not eaten").withColumn("text", F.when(F.col("took") == 1, F.col("one")).when(F.col("took") == 2, F.col("two")).otherwise(F.col("text")))
    headed = scene("text") | T.has(F.col("text"), r"^(\d{1,3}[A-Za-z]?\.?\s+)?(INT|EXT)[.\s\/]", True)
    kind = F.when(F.col("told") & headed, "scene").when(F.col("told"), "action").when(S.is_european_cue(F.col("text")), "character").otherwise("dialogue")
    mark = F.when(kind == "scene", "# ").when(kind == "character", "@").when(kind == "dialogue", "- ").otherwise("")
    return lines.select("work", F.col("line_no").cast("int").alias("line_no"), kind.alias("type"), F.concat(mark, "text").alias("text"))
