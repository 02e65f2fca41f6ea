"""Boilerplate by frequency, the findings table of a text, and its repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import patterns as P
from ..functions import text as T
from .lines import by_line, so_far, to_text
from .windows import in_runs, is_repeat, normal_spacing, reflow

#: Counts from which a repeated thing is boilerplate.
HEADER_REPEATS, LINE_REPEATS, URL_REPEATS = 4, 3, 5
HEAD_SIGNAL = (
    r"©|COPYRIGHT|판권|ALL RIGHTS|CORPORATION|제출용|촬영 대본|SHOOTING DRAFT|각색 부문|Screenplay by|Written by|원작 소설|Based on|주소|Blvd\."
    r"|CA \d{5}"
)


def frequent(rows: DataFrame, key: Column, least: int | Column, by: tuple[str, ...] = ("work",)) -> DataFrame:
    """(by, key, n): keys that occur `least` times or more."""
    return rows.select(*by, key.alias("key")).filter(F.col("key").isNotNull()).groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def repeated_lines(lines: DataFrame, least: int = LINE_REPEATS) -> DataFrame:
    """(work, text, n): lines that a work has `least` times or more."""
    t = T.trim(F.col("text"))
    return frequent(lines.filter(~T.is_blank(F.col("text"))), t, least).select("work", F.col("key").alias("text"), "n")


def running_foreign_lines(lines: DataFrame, least: int = LINE_REPEATS) -> DataFrame:
    """Lines of twenty characters or more, unmarked and without Hangul, that return with other numbers in them."""
    t = T.trim(F.col("text"))
    ours = (F.length(t) >= 20) & (T.latin(t) >= 8) & (T.hangul(t) == 0) & ~T.has(t, r"^[#@(\[-]")
    key = F.when(ours, T.sub(t, r"\d+", "#"))
    rows = lines.withColumn("key", key)
    return rows.join(frequent(lines, key, least), ["work", "key"], "left_semi").select("work", "line_no", "text")


def edge_headers(lines: DataFrame, depth: int = 2, share: float = 0.2) -> DataFrame:
    """(work, key, pages): signatures that return at the top or bottom of pages; lines have a page column.

    A signature counts once a page, and is a header from max(3, share of the pages) on.
    """
    top, bottom = W.partitionBy("work", "page").orderBy("line_no"), W.partitionBy("work", "page").orderBy(F.desc("line_no"))
    rows = lines.filter(~T.is_blank(F.col("text"))).withColumn("down", F.row_number().over(top)).withColumn("up", F.row_number().over(bottom))
    edge = rows.filter((F.col("down") <= depth) | (F.col("up") <= depth)).select("work", "page", T.signature(F.col("text")).alias("key")).filter(F.length("key") >= 3)
    pages = lines.groupBy("work").agg(F.count_distinct("page").alias("n_pages"))
    counts = edge.distinct().groupBy("work", "key").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(pages, "work").filter(F.col("pages") >= F.greatest(F.lit(3), F.ceil(F.col("n_pages") * share))).drop("n_pages")


def strip_edge_headers(lines: DataFrame, **options) -> DataFrame:
    keyed = lines.withColumn("key", T.signature(F.col("text")))
    return keyed.join(edge_headers(lines, **options), ["work", "key"], "left_anti").drop("key")


def indent_mode(lines: DataFrame) -> DataFrame:
    """(work, indent, n): the most frequent indentation of the non-blank lines; of equals, the one seen first."""
    rows = lines.filter(~T.is_blank(F.col("text"))).withColumn("indent", T.indent(F.col("text")))
    counts = rows.groupBy("work", "indent").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    best = counts.groupBy("work").agg(F.max_by(F.struct("indent", "n"), F.struct("n", -F.col("first"))).alias("b"))
    return best.select("work", "b.indent", "b.n")


def bilingual_blocks(lines: DataFrame) -> DataFrame:
    """(work, first_line, last_line): blocks in a foreign language that their translation follows at once.

    The next block must be Korean of 0.4 to 3 times the letters, and both have the same cue, or none and the first is prose.
    """
    return block_defects(asked(lines)).filter(F.array_contains("names", "bilingual")).select("work", "first_line", "last_line")


CATEGORIES = ("meta", "boiler", "dupe", "headNum", "dialog", "struct", "miscue", "glued", "repeat", "bilingual", "spacing")


def findings(lines: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(work, category, line_no): the defects of texts of the wanted categories, a row for each line and category.

    meta, boiler (not both), dupe, headNum, dialog, struct, miscue, glued, repeat, bilingual, spacing. What lines say of themselves and their
    neighbours is one pass over the lines of a work, and what blocks say one over its blocks, after one shuffle of the lines.
    """
    rows, found = asked(lines), None
    if set(categories) - set(OF_BLOCKS):
        found = _exploded(line_defects(rows, categories))
    if wanted := [c for c in OF_BLOCKS if c in categories]:
        part = block_defects(rows).select("work", F.explode("names").alias("category"), "first_line", "last_line").filter(F.col("category").isin(wanted))
        part = part.select("work", "category", F.explode(F.sequence("first_line", "last_line")).alias("line_no"))
        found = part if found is None else found.union(part)
    return found


#: What is asked of a line, in one pass over the lines; defects that blocks have.
LINE_RULES = ("marker", "header", "sure header", "meta", "untranslated", "shot or title", "page number at the end", "mistagged cue", "narration", "set off", "korean")
OF_BLOCKS = ("repeat", "bilingual")


def asked(lines: DataFrame, *keep: str) -> DataFrame:
    """(work, line_no, t, marks, keep): trimmed lines with what LINE_RULES say of them. Defects of lines and of blocks read all four columns, so they share a shuffle by work."""
    return lines.select("work", "line_no", T.trim(F.col("text")).alias("t"), *keep).withColumn("marks", P.marks(F.col("t"), LINE_RULES))


def line_findings(lines: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """The findings that a line, its neighbours and the first line of its block decide."""
    return _exploded(line_defects(asked(lines), categories))


def _exploded(rows: DataFrame) -> DataFrame:
    names = F.array_compact(F.array(*[F.when(has_defect(name), name) for name in CATEGORIES]))
    return rows.filter("defects != 0").select("work", F.explode(names).alias("category"), "line_no")


def has_defect(name: str) -> Column:
    """Whether a line of line_defects() has that defect."""
    return P.holds("defects", CATEGORIES, name)


def line_defects(rows: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """The rows of asked(), all of them, with their own `defects` of the wanted categories, a bit for each (has_defect()); blank lines have none."""
    t, order, is_ = F.col("t"), by_line(), lambda name: P.holds("marks", LINE_RULES, name)
    columns = rows.columns
    rows = rows.withColumns({"prev": F.lag("t").over(order), "prev_blank": F.coalesce(F.lag(t == "").over(order), F.lit(True))})
    if "glued" in categories:  # the first line of a block says whether a cue opens it
        rows = rows.withColumn("head", F.last(F.when(F.col("prev_blank") & (t != ""), t), ignorenulls=True).over(so_far()))
    head, left = F.col("head") if "glued" in categories else F.lit(""), ~is_("marker") & is_("untranslated")
    tests = {
        "meta": is_("meta"), "boiler": ~is_("meta") & is_("sure header"), "dupe": t == F.col("prev"), "headNum": is_("page number at the end"),
        "struct": left & is_("shot or title"), "dialog": left & ~is_("shot or title"), "miscue": is_("mistagged cue"),
        "glued": head.startswith("@") & ~F.col("prev_blank") & ~is_("set off") & is_("narration"), "spacing": is_("set off") & (F.col("prev") != ""),
    }
    bit = {name: F.lit(1 << k) for k, name in enumerate(CATEGORIES)}
    found = reduce(Column.bitwiseOR, [F.when((t != "") & test, bit[name]).otherwise(0) for name, test in tests.items() if name in categories], F.lit(0))
    if "boiler" not in categories:
        return rows.select(*columns, found.alias("defects"))
    # a header's shape needs a digit or one of a few words: other lines are not looked at any closer.
    # All else is decided before headers are counted: lines are ordered anew for that, and their texts and neighbours need not come along
    sig = F.when(is_("header"), T.signature(t))
    rows = rows.select(*columns, found.alias("defects"), sig.alias("sig"), (~is_("marker")).alias("plain"), ((t != "") & ~is_("meta")).alias("may"))
    often = F.count(F.when(F.col("plain") & (F.length("sig") >= 2), 1)).over(W.partitionBy("work", "sig"))
    boiler = F.col("may") & F.col("sig").isNotNull() & (F.col("often") >= HEADER_REPEATS)
    return rows.withColumn("often", often).select(*columns, F.when(boiler, F.col("defects").bitwiseOR(bit["boiler"])).otherwise(F.col("defects")).alias("defects"))


def block_defects(rows: DataFrame) -> DataFrame:
    """(work, first_line, last_line, names): blocks of the rows of asked(), with their defects; see repeated_blocks and bilingual_blocks. Some that have none are not among them.

    Works of one block have neither: their lines are not put together. Blocks are looked at closely where a Korean one follows.
    """
    t, order, korean = F.col("t"), W.partitionBy("work").orderBy("block_no"), P.holds("marks", LINE_RULES, "korean")
    starts = (t != "") & F.coalesce(F.lag(t == "").over(by_line()), F.lit(True))
    rows = rows.withColumn("block_no", F.sum(starts.cast("int")).over(so_far())).filter(t != "")
    rows = rows.withColumn("blocks", F.max("block_no").over(W.partitionBy("work"))).filter("blocks > 1")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"])
    blocks = rows.groupBy("work", "block_no").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), ordered.alias("lines"), F.max(korean).alias("korean"))
    ahead = {"next_korean": F.coalesce(F.lead("korean").over(order), F.lit(False)), "next_lines": F.lead("lines").over(order)}
    blocks = in_runs(blocks, order).withColumns(ahead).filter(is_repeat() | F.col("next_korean"))
    # null where no Korean block follows: patterns find nothing in it, also where the engine asks all of them before it combines the answers
    lines, after = (F.when(F.col("next_korean"), F.col(c)) for c in ("lines", "next_lines"))
    cue = lambda b: F.when(F.element_at(b, 1).startswith("@"), T.sub(F.element_at(b, 1), r"\s"))
    told = lambda b: F.array_join(F.filter(b, lambda x: ~x.startswith("@")), " ")
    # columns of their own: many tests ask for a body, which is put together once
    blocks = blocks.withColumns({"body": told(lines), "following": told(after)})
    body, following, own_cue, next_cue = F.col("body"), F.col("following"), cue(lines), cue(after)
    letters, syllables = T.latin(body), T.hangul(following)
    foreign = (T.hangul(body) == 0) & (letters >= 8) & (syllables >= 2) & (syllables / F.greatest(F.lit(1), letters)).between(0.4, 3)
    other = F.exists(lines, T.is_transitionish) | T.looks_foreign(body) | T.looks_like_title(body) | F.element_at(lines, 1).startswith("[")
    prose = T.has(body, "[a-z]") & (T.word_count(body) >= 3)
    same = F.coalesce(own_cue == next_cue, F.lit(False)) | (own_cue.isNull() & next_cue.isNull() & prose)
    bilingual = F.col("next_korean") & foreign & ~other & same
    names = F.array_compact(F.array(F.when(is_repeat(), "repeat"), F.when(bilingual, "bilingual")))
    return blocks.select("work", "first_line", "last_line", names.alias("names"))


def glued_actions(lines: DataFrame) -> DataFrame:
    """Lines after the first of a block that a cue opens which read like narration."""
    return lines.join(line_findings(lines, ("glued",)), ["work", "line_no"], "left_semi").select("work", "line_no", "text")


def split_glued(lines: DataFrame) -> DataFrame:
    """Lines with a blank one before each glued action, unless one is there; numbered anew."""
    glued = glued_actions(lines).select("work", "line_no", F.lit(True).alias("glued"))
    rows = lines.withColumn("prev_blank", F.lag(T.is_blank(F.col("text"))).over(by_line())).join(glued, ["work", "line_no"], "left")
    pieces = F.when(F.col("glued") & ~F.coalesce("prev_blank", F.lit(True)), F.array(F.lit(""), F.col("text"))).otherwise(F.array("text"))
    return _renumbered(rows.select("work", "line_no", F.posexplode(pieces).alias("part", "text")))


def _renumbered(rows: DataFrame) -> DataFrame:
    number = F.row_number().over(W.partitionBy("work").orderBy("line_no", "part")) - 1
    return rows.select("work", number.cast("int").alias("line_no"), "text")


def summary(lines: DataFrame) -> DataFrame:
    """One row per work with a count per category; spacing counts only beyond 15 % of the lines; autofixable and review are totals. Of a null work the lines alone are counted.

    Bilingual doubles are counted by block, all others by line.
    """
    rows, names = asked(lines), list(CATEGORIES)
    known = F.col("work").isNotNull()
    own = [F.count_if(known & has_defect(name)).alias(name) for name in names if name not in OF_BLOCKS]
    counts = line_defects(rows).groupBy("work").agg(F.count(F.lit(1)).alias("lines"), *own)
    has = lambda name: known & F.array_contains("names", name)
    repeats = F.sum(F.when(has("repeat"), F.col("last_line") - F.col("first_line") + 1)).alias("repeat")
    blocks = block_defects(rows).groupBy("work").agg(repeats, F.count_if(has("bilingual")).alias("bilingual"))
    # no join: it would ask one side for known works, and the two would no longer share their shuffle
    parts = counts.unionByName(blocks, allowMissingColumns=True).groupBy("work")
    rows = parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", *names)])
    rows = rows.withColumn("spacing", F.when(F.col("spacing") > F.col("lines") * 0.15, F.col("spacing")).otherwise(0))
    fixable = F.col("meta") + F.col("boiler") + F.col("dupe") + F.col("repeat") + F.col("bilingual") + F.col("headNum")
    return rows.select("work", "lines", *names, fixable.alias("autofixable"), F.col("dialog").alias("review"))


def head_junk(lines: DataFrame) -> DataFrame:
    """Unmarked lines before the first heading of works that have a copyright or title mark there."""
    return with_head_junk(lines.select("work", "line_no", T.trim(F.col("text")).alias("t"))).filter("head_junk").select("work", "line_no")


def with_head_junk(rows: DataFrame) -> DataFrame:
    """Rows of trimmed lines `t`, all of them, with head_junk; see there."""
    t, whole, before = F.col("t"), W.partitionBy("work"), F.coalesce(F.col("line_no") < F.col("first_head"), F.lit(False))
    rows = rows.withColumn("first_head", F.min(F.when(t.startswith("#") & T.has(t, r"^#\s"), F.col("line_no"))).over(whole))
    rows = rows.withColumn("signed", F.max(T.has(F.when(before, t), HEAD_SIGNAL, True)).over(whole))
    unmarked = (t != "") & ~T.has(F.when(before, t), r"^(FADE|\[|@|#)", True)
    return rows.withColumn("head_junk", F.coalesce(before & F.col("signed") & unmarked, F.lit(False))).drop("first_head", "signed")


def autofix(lines: DataFrame) -> DataFrame:
    """(work, text): texts without the defects that are safe to mend.

    Remarks, boilerplate, repeats, bilingual doubles and title pages go; headings lose repeats and page numbers; captions become marked lines
    between blank ones; spacing is made even; broken sentences are joined.
    """
    rows = with_head_junk(line_defects(asked(lines, "text"), ("meta", "boiler", "dupe")))
    rows = rows.withColumn("korean", F.max(P.holds("marks", LINE_RULES, "korean").cast("int")).over(W.partitionBy("work")))
    rows = rows.filter((F.col("defects") == 0) & ~F.col("head_junk")).select("work", "line_no", "text", "korean", F.lit(False).alias("gone"))
    blocks = block_defects(asked(lines)).filter(F.size("names") > 0)
    gone = blocks.select("work", F.explode(F.sequence("first_line", "last_line")).alias("line_no"), F.lit(True).alias("gone"))
    # lines and what goes of them are dealt by work already: they meet in a window, which a join by work and line would deal anew
    met = rows.unionByName(gone, allowMissingColumns=True).withColumn("gone", F.max("gone").over(W.partitionBy("work", "line_no")))
    kept = met.filter(~F.col("gone")).drop("gone")
    t = T.trim(F.col("text"))
    kept = kept.withColumn("head", F.when(t.startswith("#"), t)).withColumn("folded", T.collapse_repeats(F.col("head")))
    kept = kept.withColumn("text", F.when(F.col("folded") != F.col("head"), F.col("folded")).otherwise(F.col("text"))).drop("head", "folded")
    kept = kept.withColumn("text", F.when(T.has_page_number(T.trim(F.col("text"))), T.rtrim(T.sub(F.col("text"), r"\d{1,3}\s*$"))).otherwise(F.col("text")))
    caption = T.has(T.trim(F.col("text")), r"^(TITLE|SUPER|CHYRON)\s*[:：]", True)
    body = T.sub(T.trim(F.col("text")), r"^(TITLE|SUPER|CHYRON)\s*[:：]\s*", "", True)
    marked = F.concat(F.when(F.col("korean") == 1, "[자막: ").otherwise("[SUPER: "), body, F.lit("]"))
    pieces = F.when(caption, F.array(F.lit(""), marked, F.lit(""))).otherwise(F.array("text"))
    rows = _renumbered(kept.select("work", "line_no", F.posexplode(pieces).alias("part", "text")))

    spaced = normal_spacing(rows)
    spaced = _renumbered(spaced.select("work", "line_no", F.posexplode(F.when(F.col("gap"), F.array(F.lit(""), F.col("text"))).otherwise(F.array("text"))).alias("part", "text")))
    return to_text(reflow(spaced))


def strip_markup(text: Column) -> Column:
    """Tags as blanks; two or more blanks as a line break."""
    return T.trim(T.sub(F.regexp_replace(text, "<[^>]+>", " "), r"\s{2,}", "\n"))


def strip_rtf(text: Column) -> Column:
    """Control words, braces and what is not ASCII gone; three or more line breaks as two."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\\[a-z]+-?\d*\s?", ""), r"[{}]", "")
    return T.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\x00-\x7F]", ""), r"\n{3,}", "\n\n"))
