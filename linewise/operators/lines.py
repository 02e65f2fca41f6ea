"""From texts to rows: lines, blocks, scenes, chunks, tokens; and back to texts.

Tables of lines have the columns work, line_no (from 0) and text. Windows run within one work, which is one script or
document, so their memory is bounded by the longest text, and works spread over tasks by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import shapes as S
from ..functions import text as T


def by_line():
    """The window over the lines of a work in order."""
    return W.partitionBy("work").orderBy("line_no")


def so_far():
    return by_line().rowsBetween(W.unboundedPreceding, 0)


def to_lines(texts: DataFrame, work: str, text: str, *keep: str) -> DataFrame:
    """One row per line; an empty text is one empty line, a null text none."""
    return texts.select(F.col(work).alias("work"), *keep, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "text"))


def to_text(lines: DataFrame, order: str = "line_no", separator: str = "\n") -> DataFrame:
    """(work, text): the lines of each work joined again in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    return lines.groupBy("work").agg(F.array_join(ordered, separator).alias("text"))


def with_blocks(lines: DataFrame) -> DataFrame:
    """The non-blank lines with block_no (from 0): a block is a run of lines without a blank one between."""
    blank = T.is_blank(F.col("text"))
    starts = ~blank & F.coalesce(F.lag(blank).over(by_line()), F.lit(True))
    return lines.withColumn("block_no", F.sum(starts.cast("int")).over(so_far()) - 1).filter(~blank)


def to_blocks(lines: DataFrame) -> DataFrame:
    """(work, block_no, first_line, last_line, lines): each block with its trimmed lines."""
    rows = with_blocks(lines)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", T.trim(F.col("text")).alias("t")))), lambda x: x["t"])
    return rows.groupBy("work", "block_no").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), ordered.alias("lines"))


def with_segments(lines: DataFrame, starts: Column, name: str = "scene_no") -> DataFrame:
    """Lines with the number of the segment they are in (from 0): it starts at each flagged line, and at the first."""
    before = F.sum(starts.cast("int")).over(so_far())
    first = F.first(starts).over(so_far())
    return lines.withColumn(name, before - first.cast("int"))


def to_scenes(texts: DataFrame, work: str, text: str) -> DataFrame:
    """(work, scene_no, scene): a text cut before each line that starts with `# `; pieces are trimmed, empty ones go, numbers are without gaps."""
    pieces = F.transform(F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r", ""), r"\n(?=# )"), T.trim)
    return texts.select(F.col(work).alias("work"), F.posexplode(F.filter(pieces, lambda p: p != "")).alias("scene_no", "scene"))


def split_long(lines: DataFrame, size: int = 80) -> DataFrame:
    """Lines with scene_no renumbered so that no scene has more than `size` lines; continued marks the pieces after the first."""
    within = F.row_number().over(W.partitionBy("work", "scene_no").orderBy("line_no")) - 1
    pieces = lines.withColumn("piece", F.floor(within / size).cast("int"))
    number = F.dense_rank().over(W.partitionBy("work").orderBy("scene_no", "piece")) - 1
    return pieces.withColumn("part_no", number).withColumn("continued", F.col("piece") > 0)


def edit_chunks(lines: DataFrame, longest: int = 30, step: int = 25) -> DataFrame:
    """(work, chunk_no, first_line, last_line): one chunk per heading, those of more than `longest` lines cut every `step` lines.

    A heading that follows fewer than three lines of a chunk stays in it.
    """
    state = F.aggregate(
        F.array_sort(F.collect_list(F.struct("line_no", T.trim(F.col("text")).startswith("#").alias("h")))),
        F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("start")),
        lambda acc, x: F.when(
            x["h"] & (x["line_no"] > 0) & (x["line_no"] - acc["start"] > 2),
            F.struct(F.array_append(acc["cuts"], x["line_no"]).alias("cuts"), x["line_no"].alias("start")),
        ).otherwise(acc),
    )
    ends = lines.groupBy("work").agg(state.alias("s"), F.count(F.lit(1)).cast("int").alias("n"))
    bounds = ends.select("work", "n", F.concat(F.array(F.lit(0)), F.col("s.cuts"), F.array("n")).alias("b"))
    pairs = bounds.select("work", F.explode(F.transform(F.sequence(F.lit(1), F.size("b") - 1), lambda i: F.struct(F.element_at("b", i).alias("a"), F.element_at("b", i + 1).alias("z")))).alias("p"))
    pairs = pairs.select("work", "p.a", "p.z").filter("z - a > 2")
    cuts = F.when(F.col("z") - F.col("a") > longest, F.sequence(F.col("a"), F.col("z") - 1, F.lit(step))).otherwise(F.array("a"))
    pieces = pairs.select("work", "z", F.explode(cuts).alias("first_line"), F.when(F.col("z") - F.col("a") > longest, step).otherwise(F.col("z") - F.col("a")).alias("len"))
    pieces = pieces.select("work", "first_line", (F.least(F.col("first_line") + F.col("len"), F.col("z")) - 1).alias("last_line"))
    return pieces.withColumn("chunk_no", F.row_number().over(W.partitionBy("work").orderBy("first_line")) - 1)


def halves_by_size(blocks: DataFrame) -> DataFrame:
    """Blocks with `half` 0 or 1: the cut is after the first block with which half of the work's characters is reached."""
    size = F.sum(F.length("text")).over(W.partitionBy("work"))
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy("work").orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("half", (before >= size / 2).cast("int"))


def words(texts: DataFrame, work: str, text: str, pattern: str = r"[A-Za-z][A-Za-z'’]*", lower: bool = False) -> DataFrame:
    """(work, word): every token of the pattern, with repeats."""
    source = F.lower(F.col(text)) if lower else F.col(text)
    return texts.select(F.col(work).alias("work"), F.explode(F.regexp_extract_all(source, F.lit(pattern), F.lit(0))).alias("word"))


#: Tokens for comparing two readings of one text: letters with inner marks, four or more.
LONG_WORD = r"[\p{L}][\p{L}'’-]{3,}"


def without_fake_cues(lines: DataFrame) -> DataFrame:
    """Lines whose cues that name no speaker have lost their mark: they are narration, and what follows them no speech."""
    t = T.trim(F.col("text"))
    fake = t.startswith("@") & ~S.is_marked_cue(t)
    return lines.withColumn("text", F.when(fake, T.trim(T.sub(t, r"^@\s*"))).otherwise(F.col("text")))


def typed_blocks(lines: DataFrame) -> DataFrame:
    """(work, block_no, type, text): scene, character, paren, dialogue and action blocks of marked text.

    A cue opens dialogue, which lasts until the next heading or cue or a blank line after something was said; a parenthetical stands alone;
    neighbouring lines of one type are one block.
    """
    t = T.trim(F.col("text"))
    rows = with_dialogue(lines).withColumn("t", t).filter(F.col("t") != "")
    kind = (
        F.when(F.col("t").startswith("#"), "scene").when(F.col("t").startswith("@"), "character")
        .when(F.col("t").startswith("(") & F.col("t").endswith(")"), "paren").when(F.col("in_dialogue") | F.col("t").startswith("- "), "dialogue").otherwise("action")
    )
    rows = rows.withColumn("type", kind)
    apart = F.col("type").isin("scene", "character", "paren") | ~F.col("type").eqNullSafe(F.lag("type").over(by_line())) | (F.col("line_no") - F.lag("line_no").over(by_line()) > 1)
    rows = rows.withColumn("block_no", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(so_far()) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), " ")
    return rows.groupBy("work", "block_no").agg(F.first("type").alias("type"), joined.alias("text"))


def with_dialogue(lines: DataFrame) -> DataFrame:
    """Lines with in_dialogue: between a cue and the first blank line after something was said, a heading, or the next cue.

    As windows: a segment starts at each cue or heading; the first line that is said and the first blank line after it are minima over the segment.
    """
    t = T.trim(F.col("text"))
    rows = lines.withColumns({"is_cue": t.startswith("@"), "is_head": t.startswith("#"), "said": (t != "") & ~t.startswith("(") & ~t.startswith("@") & ~t.startswith("#"), "blank": t == ""})
    rows = rows.withColumn("segment", F.sum((F.col("is_cue") | F.col("is_head")).cast("int")).over(so_far()))
    whole, in_order = W.partitionBy("work", "segment"), W.partitionBy("work", "segment").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("after_cue", F.first("is_cue").over(in_order))
    rows = rows.withColumn("first_said", F.min(F.when(F.col("said"), F.col("line_no"))).over(whole))
    rows = rows.withColumn("closed_at", F.min(F.when(F.col("blank") & (F.col("line_no") > F.col("first_said")), F.col("line_no"))).over(whole))
    in_dialogue = F.col("after_cue") & F.col("said") & (F.col("closed_at").isNull() | (F.col("line_no") < F.col("closed_at")))
    return rows.withColumn("in_dialogue", F.coalesce(in_dialogue, F.lit(False))).drop("is_cue", "is_head", "blank", "segment", "after_cue", "first_said", "closed_at")


def scene_kinds(lines: DataFrame) -> DataFrame:
    """(work, scene_no, kinds): the kind letters of the non-blank lines of each scene, in order."""
    rows = with_segments(lines, T.trim(F.col("text")).startswith("#")).filter(~T.is_blank(F.col("text"))).withColumn("kind", T.kind(F.col("text")))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "kind"))), lambda x: x["kind"]), "")
    return rows.groupBy("work", "scene_no").agg(kinds.alias("kinds"))
