"""Measures, classes, warnings and checks of texts, a row for each work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import shapes as S
from ..functions import text as T
from .joins import one_letter_variants
from ..functions.rules import PLACES
from .lines import typed_blocks
from .windows import close_repeated_cues, dialogue_measures, empty_cues, next_matching



def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def metrics(lines: DataFrame) -> DataFrame:
    """(work, scenes, cues, broken_cue_ratio, noise_ratio, dialogue_ratio, avg_action_words, songs, credits)."""
    noise = T.has(F.col("text"), r"[\^~|\\]") & ~T.has(F.col("text"), "[가-힣]{2,}|[A-Za-z]{4,}")
    total = lambda c: F.sum(c.cast("long"))
    counts = lines.groupBy("work").agg(
        total(T.has(F.col("text"), r"^#\s")).alias("scenes"), total(F.col("text").startswith("@")).alias("cues"), total(T.has(F.col("text"), "^@[^A-Z가-힣]")).alias("broken"),
        total(~T.is_blank(F.col("text"))).alias("full"), total(~T.is_blank(F.col("text")) & noise).alias("noise"),
        F.sum(T.count_of(F.col("text"), r"\b(sings?|singing|song)\b", True) + T.count_of(F.col("text"), "노래(를|한다|해|하)")).cast("long").alias("songs"),
        F.sum(T.count_of(F.col("text"), r"\[(크레딧|credit|super|삽입)", True)).cast("long").alias("credits"),
    )
    rows = counts.join(dialogue_measures(lines), "work", "left").fillna(0)
    return rows.select(
        "work", "scenes", "cues", _ratio(F.col("broken"), F.col("cues")).alias("broken_cue_ratio"), _ratio(F.col("noise"), F.col("full")).alias("noise_ratio"),
        _ratio(F.col("dialogue"), F.col("dialogue") + F.col("action")).alias("dialogue_ratio"), _ratio(F.col("action_words"), F.col("action")).alias("avg_action_words"), "songs", "credits",
    )


def profile(measured: DataFrame) -> DataFrame:
    """Metrics with source (scan, digital), weight (dialogue, description, mixed) and flags."""
    scan = (F.col("noise_ratio") > 0.01) | (F.col("broken_cue_ratio") > 0.03)
    weight = F.when(F.col("dialogue_ratio") >= 0.65, "dialogue").when(F.col("dialogue_ratio") <= 0.45, "description").otherwise("mixed")
    flags = F.array_compact(F.array(F.when(F.col("songs") >= 4, "songs"), F.when(F.col("credits") >= 8, "credits")))
    return measured.withColumns({"source": F.when(scan, "scan").otherwise("digital"), "weight": weight, "flags": flags})


def distribution(profiles: DataFrame) -> DataFrame:
    """(property, value, works): how many works have each source, weight and flag."""
    pairs = F.concat(F.array(F.struct(F.lit("source").alias("property"), F.col("source").alias("value")), F.struct(F.lit("weight").alias("property"), F.col("weight").alias("value"))), F.transform("flags", lambda f: F.struct(F.lit("flag").alias("property"), f.alias("value"))))
    return profiles.select(F.explode(pairs).alias("p")).groupBy("p.property", "p.value").agg(F.count(F.lit(1)).alias("works"))


def text_classes(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(work, actions, avg_action_words, long_action_pct, dialogues, long_dialogue_pct, garbage_pct, cls).

    C: more than 1.5 % characters of no known script; A: lines run together (long narration or speech); B: neither.
    """
    n = T.word_count(F.col("text"))
    of = lambda kind, c: F.sum(F.when(F.col("type") == kind, c))
    rows = typed_blocks(lines).groupBy("work").agg(
        F.coalesce(of("action", F.lit(1)), F.lit(0)).alias("actions"), of("action", n).alias("w"), of("action", (n > 60).cast("int")).alias("long_a"),
        F.coalesce(of("dialogue", F.lit(1)), F.lit(0)).alias("dialogues"), of("dialogue", (n > 50).cast("int")).alias("long_d"),
    )
    odd = F.regexp_count(F.col("text"), F.lit(r"[^\x09\x0A\x0D\x20-\x7E가-힣\x{A0}-\x{24F}\x{2010}-\x{2027}\x{2030}-\x{205E}]"))
    garbage = texts.select("work", (T.round_half_up(_ratio(odd, F.length("text")) * 1000) / 10).alias("garbage_pct"))
    rows = rows.join(garbage, "work").withColumns({
        "avg_action_words": T.round_half_up(_ratio(F.col("w"), F.col("actions"))), "long_action_pct": T.round_half_up(_ratio(F.col("long_a"), F.col("actions")) * 100),
        "long_dialogue_pct": T.round_half_up(_ratio(F.col("long_d"), F.col("dialogues")) * 100),
    })
    long = (F.col("avg_action_words") > 45) | (F.col("long_action_pct") > 30) | (F.col("long_dialogue_pct") > 25)
    cls = F.when(F.col("garbage_pct") > 1.5, "C").when(long, "A").otherwise("B")
    return rows.select("work", "actions", "avg_action_words", "long_action_pct", "dialogues", "long_dialogue_pct", "garbage_pct", cls.alias("cls"))


def missed_headings(lines: DataFrame) -> DataFrame:
    """(work, candidates): short lines in capitals, unmarked, within a marked script: headings that were not seen as such."""
    t = T.trim(F.col("text"))
    alone = (t != "") & ~T.has(t, r"^([#@(]|- )") & (F.length(t) <= 70) & T.capitals(t, 4, 0.85)
    return lines.groupBy("work").agg(F.sum(alone.cast("long")).alias("candidates"))


def scene_flags(lines: DataFrame) -> DataFrame:
    """(work, scenes, avg_len, max_len, candidates, flags) of marked scripts: scene_lengths, and more missed headings than scenes; a work with under two scenes has but the flag `no scenes`."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    texts = lines.groupBy("work").agg(ordered.alias("text"))
    own = F.filter(F.split("text", r"(?m)^(?=# )"), lambda x: ~T.is_blank(x))
    rows = texts.select("work", F.length("text").alias("size"), F.size(own).alias("scenes"), F.array_max(F.transform(own, F.length)).alias("max_len")).join(missed_headings(lines), "work")
    mean = T.round_half_up(F.col("size") / F.greatest("scenes", F.lit(1)))
    rows = rows.withColumn("avg_len", mean)
    found = F.array_compact(F.array(F.when(F.col("avg_len") > 3200, "long mean"), F.when(F.col("max_len") > 20000, "long scene"), F.when(F.col("candidates") > F.col("scenes"), "missed headings")))
    return rows.select("work", "scenes", "avg_len", "max_len", "candidates", F.when(F.col("scenes") < 2, F.array(F.lit("no scenes"))).otherwise(found).alias("flags"))


def scene_lengths(scenes: DataFrame) -> DataFrame:
    """(work, scenes, avg_len, max_len, flags): mean over 3,200 or longest over 20,000 characters are flagged."""
    rows = scenes.groupBy("work").agg(F.count(F.lit(1)).alias("scenes"), F.avg(F.length("scene")).alias("avg_len"), F.max(F.length("scene")).alias("max_len"))
    return rows.withColumn("flags", F.array_compact(F.array(F.when(F.col("avg_len") > 3200, "long mean"), F.when(F.col("max_len") > 20000, "long scene"))))


def scene_warnings(scenes: DataFrame, raw: DataFrame) -> DataFrame:
    """(work, level, code, value): what looks wrong with how a text was cut into scenes; raw has (work, text).

    A low share of recognised headings is told only where none of single_scene, few_scenes and undercount is.
    """
    place = f"({PLACES})"
    numbered, nth = r"^[A-Z]?\d+\.?\s+" + place, r"^SCENE\s+\d+\s*[-–.]"
    is_raw = lambda t: T.has(t, "^" + place, True) | T.has(t, numbered, True) | T.has(t, nth, True)
    clean = lambda t: T.sub(t, r"^[A-Za-z0-9*'\"\\/|.\-]{1,3}\s{2,}")
    heads = raw.select("work", F.explode(F.split("text", "\n")).alias("l")).withColumn("l", T.trim(F.col("l"))).groupBy("work").agg(F.sum((is_raw(F.col("l")) | is_raw(clean(F.col("l")))).cast("int")).alias("raw_heads"))
    first = F.coalesce(F.element_at(F.filter(F.transform(F.split("scene", "\n"), T.trim), lambda x: x != ""), 1), F.lit(""))
    rows = scenes.withColumn("first", first).withColumn("lines", F.size(F.split("scene", "\n")))
    known = is_raw(F.col("first")) | T.has(F.col("first"), r"^#\s*" + place, True) | T.has(F.col("first"), "^(INSERT|INTERCUT|MONTAGE|SERIES OF SHOTS)", True)
    s = rows.groupBy("work").agg(
        F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"), F.sum((F.col("lines") > 80).cast("int")).alias("long"), F.sum(T.has(F.col("first"), numbered, True).cast("int")).alias("numbered"),
        F.sum(T.has(F.col("first"), nth, True).cast("int")).alias("named"), F.sum((known & (F.col("scene_no") > 0)).cast("int")).alias("known"),
    ).join(heads, "work", "left").fillna(0)
    avg = T.round_half_up(F.col("lines") / F.col("n"))
    single, few = F.col("n") == 1, F.col("n").between(2, 4)
    under = (F.col("raw_heads") > 0) & (F.col("n") < F.col("raw_heads") * 0.7) & (F.col("n") < F.col("raw_heads") - 3)
    warn = lambda cond, level, code, value: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), value.cast("double").alias("value")))
    share = F.col("known") / (F.col("n") - 1)
    rules = [
        warn(single, "error", "single_scene", F.col("lines")), warn(few, "warn", "few_scenes", F.col("n")), warn(under, "warn", "undercount", F.col("raw_heads")),
        warn(F.col("long") > 0, "info", "force_split", F.col("long")), warn((F.col("n") > 1) & (avg > 120), "warn", "large_avg", avg),
        warn(F.col("numbered") > 0, "info", "numbered_headings", F.col("numbered")), warn(F.col("named") > 0, "info", "scene_n_format", F.col("named")),
        warn((F.col("n") > 6) & (share < 0.35) & ~under, "warn", "low_heading_ratio", share),
    ]
    return s.select("work", F.explode(F.array_compact(F.array(*rules))).alias("w")).select("work", "w.level", "w.code", "w.value")


def structure_agrees(formatted: Column, translated: Column) -> Column:
    """Whether a translation has the scenes, speakers and about the lines of its source."""
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    full = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: ~T.is_blank(x)))
    cf, ct, bf, bt = count(formatted, "(?m)^@"), count(translated, "(?m)^@"), full(formatted), full(translated)
    cues = (ct <= cf) & ((cf == 0) | (ct >= cf * 0.5))
    body = (bf == 0) | bt.between(bf * 0.6, bf * 1.6)
    return F.coalesce(~T.is_blank(translated) & (count(formatted, "(?m)^#") == count(translated, "(?m)^#")) & cues & body, F.lit(False))


def result_gate(lines: DataFrame, is_result: bool = True) -> DataFrame:
    """(work, issue, value): reasons not to take a result: noise of many kinds, broken headings, untranslated body."""
    noise = T.has(F.col("text"), r"https?:\/\/", True)
    head, name = T.has(F.col("text"), r"^#\s"), T.sub(F.col("text"), r"^#\s*")
    doubled = head & F.regexp_like(name, F.lit(r"(.{8,}?)\1"))
    mixed = head & T.has(name, "[A-Z]{3,}[ .].*[A-Z]{3,}")
    body = ~T.is_blank(F.col("text")) & ~T.has(F.col("text"), "^[#@(]")
    foreign = body & (T.hangul(F.col("text")) == 0) & T.has(F.col("text"), "[A-Za-z]{4,}") & ~T.has(T.trim(F.col("text")), "^[A-Z][A-Z .]{2,}$")
    total = lambda c: F.sum(c.cast("long"))
    s = lines.groupBy("work").agg(total(noise).alias("noise"), F.count_distinct(F.when(noise, T.trim(F.col("text")))).alias("kinds"), total(head).alias("heads"), total(doubled).alias("doubled"), total(mixed).alias("mixed"), total(body).alias("body"), total(foreign).alias("foreign"))
    broken = F.greatest("doubled", F.col("mixed") if is_result else F.lit(0))
    issue = lambda cond, name, v: F.when(cond, F.struct(F.lit(name).alias("issue"), v.cast("long").alias("value")))
    rules = [issue((F.col("noise") >= 10) & (F.col("kinds") >= 8), "noise", F.col("kinds")), issue((F.col("heads") >= 5) & (broken >= F.col("heads") * 0.3), "headings", broken)]
    if is_result:
        rules.append(issue((F.col("body") >= 20) & (F.col("foreign") / F.col("body") > 0.15), "untranslated", F.col("foreign")))
    return s.select("work", F.explode(F.array_compact(F.array(*rules))).alias("i")).select("work", "i.issue", "i.value")


def verification(lines: DataFrame) -> DataFrame:
    """(work, cues, empty_ratio, long_dialogue, scenes, level): whether a source is fit for work: pass, warn or bad.

    Cues without speech warn beyond 3 % and are bad beyond 8 %; speech of over 600 characters warns; a text without headings or cues is bad.
    """
    cues = lines.groupBy("work").agg(F.sum(T.trim(F.col("text")).startswith("@").cast("long")).alias("cues"), F.sum(T.trim(F.col("text")).startswith("#").cast("long")).alias("scenes"))
    empty = empty_cues(lines).groupBy("work").agg(F.count(F.lit(1)).alias("empty"))
    long = typed_blocks(lines).filter((F.col("type") == "dialogue") & (F.length("text") > 600)).groupBy("work").agg(F.count(F.lit(1)).alias("long_dialogue"))
    rows = cues.join(empty, "work", "left").join(long, "work", "left").fillna(0).withColumn("empty_ratio", _ratio(F.col("empty"), F.col("cues")))
    level = F.when((F.col("empty_ratio") > 0.08) | (F.col("scenes") == 0) | (F.col("cues") == 0), "bad").when((F.col("empty_ratio") > 0.03) | (F.col("long_dialogue") > 0), "warn").otherwise("pass")
    return rows.select("work", "cues", "scenes", "empty_ratio", "long_dialogue", level.alias("level"))


def source_issues(lines: DataFrame) -> DataFrame:
    """(work, level, code, value): what makes a source unfit, by six tests; warn, or bad where there is much of it.

    empty_cues: cues without speech, over 3 % (bad over 8 %); junk: lines of four words or more of which over half look misread (bad over 5); heading: headings that start one letter from INT or EXT (bad over 3);
    variants: rare names one letter from frequent ones (bad over 5); long_dialogue: speech of over 600 characters (bad over 10); few_scenes, few_cues, little_dialogue: under five headings, under ten cues, under 0.6 lines of
    speech a cue (always bad).
    """
    t = T.trim(F.col("text"))
    rows = lines.select("work", "line_no", t.alias("t"))
    words = F.filter(F.split(T.sub(F.col("t"), r"^[-@#]\s*"), T.rx(r"\s+")), lambda w: T.has(w, "[A-Za-z]"))
    fake = F.size(F.filter(words, S.looks_fake))
    head = F.regexp_extract("t", T.rx(r"^#\s+([A-Z0-9]{3})\b"), 1)
    near = lambda place: (head != "") & (F.levenshtein(head, F.lit(place)) == 1)
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    counts = rows.groupBy("work").agg(
        one(F.col("t").startswith("#")).alias("scenes"), one(F.col("t").startswith("@")).alias("cues"), one(F.col("t").startswith("- ")).alias("said"), one((F.size(words) >= 4) & (fake > F.size(words) * 0.5)).alias("junk"),
        one((near("INT") | near("EXT")) & ~head.isin("INT", "EXT")).alias("heading"), one(F.col("t").startswith("- ") & (F.length("t") > 602)).alias("long_dialogue"),
    )
    names = rows.filter(F.col("t").startswith("@")).groupBy("work", T.trim(F.element_at(F.split(F.substring("t", 2, 1 << 20), r"\("), 1)).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    variants = one_letter_variants(names.filter("word <> ''"), by=("work",)).select("work", "word").distinct().groupBy("work").agg(F.count(F.lit(1)).alias("variants"))
    empty = empty_cues(lines).groupBy("work").agg(F.count(F.lit(1)).alias("empty"))
    all_ = counts.join(variants, "work", "left").join(empty, "work", "left").fillna(0).withColumn("ratio", _ratio(F.col("empty"), F.col("cues")))
    told = lambda when, bad, code, value: F.when(when, F.struct(F.when(bad, "bad").otherwise("warn").alias("level"), F.lit(code).alias("code"), value.cast("double").alias("value")))
    many = lambda c, most: told(F.col(c) > 0, F.col(c) > most, c, F.col(c))
    sure = lambda when, code, value: told(when, F.lit(True), code, value)
    issues = F.array_compact(F.array(
        told(F.col("ratio") > 0.03, F.col("ratio") > 0.08, "empty_cues", F.col("ratio")), many("junk", 5), many("heading", 3), many("variants", 5), many("long_dialogue", 10), sure(F.col("scenes") < 5, "few_scenes", F.col("scenes")),
        sure(F.col("cues") < 10, "few_cues", F.col("cues")), sure((F.col("cues") > 0) & (F.col("said") < F.col("cues") * 0.6), "little_dialogue", _ratio(F.col("said"), F.col("cues"))),
    ))
    return all_.select("work", F.explode(issues).alias("i")).select("work", "i.*")


def fitness(issues: DataFrame, works: DataFrame, strict: bool = False) -> DataFrame:
    """(work, fit): whether work on a source may begin: nothing bad, and, if strict, nothing at all; works have (work)."""
    worst = issues.groupBy("work").agg(F.max((F.col("level") == "bad").cast("int")).alias("bad"))
    stopped = F.coalesce(F.col("bad") == 1, F.lit(False)) | (F.col("bad").isNotNull() & F.lit(strict))
    return works.select("work").distinct().join(worst, "work", "left").select("work", (~stopped).alias("fit"))


def dialogue_floor(lines: DataFrame) -> DataFrame:
    """(work, dialogue, close, floor): the least dialogue that a shorter version must keep: pairs of one speaker close by may be joined."""
    said = lines.groupBy("work").agg(F.sum(T.trim(F.col("text")).startswith("- ").cast("long")).alias("dialogue"))
    close = close_repeated_cues(lines).groupBy("work").agg(F.count(F.lit(1)).alias("close"))
    return said.join(close, "work", "left").fillna(0).withColumn("floor", F.col("dialogue") - F.col("close"))


def duplicates_by_key(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """(key, n, first_id, last_id): keys that more than one row has, with the smallest and the largest of their ids."""
    return rows.select(key.alias("key"), F.col(id_col).alias("id")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("n > 1")


def best_of_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, the first in the order."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__rn = 1").drop("__rn")


def language_info(lines: DataFrame) -> DataFrame:
    """(work, n_lines, hangul, latin, lang): ko where over a fifth of the letters are Hangul, en where there are Latin ones, else unknown."""
    rows = lines.groupBy("work").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(T.hangul(F.col("text"))).cast("long").alias("hangul"), F.sum(T.latin(F.col("text"))).cast("long").alias("latin"))
    return rows.withColumn("lang", F.when(_ratio(F.col("hangul"), F.col("hangul") + F.col("latin")) > 0.2, "ko").when(F.col("latin") > 0, "en").otherwise("unknown"))


def cue_counts(lines: DataFrame) -> DataFrame:
    """(work, cue, n, first): how often each speaker is named."""
    return lines.filter(T.trim(F.col("text")).startswith("@")).groupBy("work", T.cue_name(F.col("text")).alias("cue")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))


def issue_counts(texts: DataFrame) -> DataFrame:
    """(work, old_credit, old_caption, bare_headings): old markers and headings without one."""
    return texts.select("work", T.count_of(F.col("text"), r"\[크레딧:").alias("old_credit"), T.count_of(F.col("text"), r"\[자막:").alias("old_caption"), F.regexp_count(F.col("text"), F.lit(r"(?m)^(INT\.|EXT\.)")).alias("bare_headings"))


def offset_drift(anchors: DataFrame) -> DataFrame:
    """(work, nth, offset): where the difference of two numberings changes; anchors have (work, nth, a, b)."""
    order = W.partitionBy("work").orderBy("nth")
    rows = anchors.withColumn("offset", F.col("b") - F.col("a")).withColumn("before", F.lag("offset").over(order))
    return rows.filter(F.col("before").isNotNull() & (F.col("offset") != F.col("before"))).select("work", "nth", "offset")


def number_anchors(source: DataFrame, result: DataFrame) -> DataFrame:
    """(work, nth, a, b): the scenes of two versions whose headings have the same numbers of two to four digits, in order; both are lines (work, line_no, text).

    Headings of the source with nothing below them do not count. Works whose numbers differ anywhere, as far as both versions go, give nothing: their numbers are no anchors.
    """
    order = W.partitionBy("work").orderBy("line_no")

    def numbered(lines: DataFrame, skip_empty: bool) -> DataFrame:
        full = lines.filter(~T.is_blank(F.col("text"))).withColumn("next", F.lead("text").over(order))
        heads = full.filter(F.col("text").startswith("# ") & ~(F.lit(skip_empty) & F.coalesce(F.col("next").startswith("# "), F.lit(False))))
        heads = heads.withColumn("scene", F.row_number().over(order) - 1)
        numbers = F.array_join(F.regexp_extract_all(T.sub(T.trim(F.col("text")), r"\s"), F.lit(r"[0-9]{2,4}"), F.lit(0)), ",")
        return heads.withColumn("numbers", numbers).filter("numbers <> ''").withColumn("nth", F.row_number().over(order) - 1).select("work", "nth", "scene", "numbers")

    a, b = numbered(source, True), numbered(result, False)
    both = a.join(b.select("work", "nth", F.col("scene").alias("b"), F.col("numbers").alias("other")), ["work", "nth"]).withColumnRenamed("scene", "a")
    unequal = both.filter("numbers <> other").select("work").distinct()
    return both.join(unequal, "work", "left_anti").select("work", "nth", "a", "b")


def trapped_names(lines: DataFrame, least: int = 5) -> DataFrame:
    """(work, name, n): names that stand in brackets, with speech after them, where a cue should: `least` times or more."""
    rows = lines.withColumn("t", T.trim(F.col("text")))
    rows = rows.withColumn("next", next_matching(F.col("t"), F.col("t") != "")).filter(T.has(F.col("t"), r"^\([A-Z가-힣][A-Z가-힣 .']{1,24}\)$") & F.col("next").startswith("- "))
    return rows.groupBy("work", F.regexp_extract("t", r"^\((.+)\)$", 1).alias("name")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def paired_by_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """(work, name, n, other, other_n): names of two lists whose counts differ by no more than max(2, 15 %)."""
    right = b.select("work", F.col("name").alias("other"), F.col("n").alias("other_n"))
    return a.join(right, "work").filter(F.abs(F.col("n") - F.col("other_n")) <= F.greatest(F.lit(2), F.col("n") * 0.15))
