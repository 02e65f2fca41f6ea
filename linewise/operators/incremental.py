"""Reuse of earlier results, and the seam for steps that an outside model does."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shapes import VOICE_MARKS
from .quality import structure_agrees


def left_in_english(lines: Column) -> Column:
    """Of the trimmed lines of a translated scene, whether each is left in English where it should not be.

    Lines with Hangul are done. A cue is left unless its name has under two letters or is initials, a short form with dots or slashes, or a known one. Other lines
    are left if they have twelve characters and ten letters, and a word of four letters or a heading's mark; but not up to two lines after a remark that names a language, nor
    addresses and transitions.
    """

    def left(x: Column, i: Column) -> Column:
        name = T.trim(T.sub(T.sub(x, r"^@"), VOICE_MARKS, "", True))
        cue = (T.latin(name) >= 2) & ~T.follows(name, "kept name")
        near = F.slice(lines, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2)))
        spared = F.exists(near, lambda p: T.follows(p, "language cue")) | T.follows(x, "address") | T.follows(x, "kept transition") | T.follows(x, "plain transition")
        other = (F.length(x) >= 12) & ~spared & (T.has(x, "[A-Za-z]{4,}") | x.startswith("#")) & (T.latin(x) >= 10)
        return ~T.has(x, "[가-힣]") & F.when(x.startswith("@"), cue).otherwise(other)

    return F.transform(lines, left)


def fully_translated(result: Column) -> Column:
    """Whether a scene's result is a finished translation: some of it in Korean, nothing left in English that should not be, and no remark of the translator."""
    lines = F.transform(F.split(result, "\n"), T.trim)
    done = T.has(result, "[가-힣]") & ~F.exists(left_in_english(lines), lambda x: x) & ~F.exists(lines, T.is_leak)
    return F.coalesce(done, F.lit(False))


def plan_work(scenes: DataFrame, previous: DataFrame, same_structure: bool = False) -> DataFrame:
    """Scenes (work, scene_no, scene) with previous and reusable: those that need no work are known before any is done.

    A previous result that is finished is reused, with `same_structure` only if it has the scenes, speakers and about the lines of its source; so is a scene with nothing to translate.
    """
    old = previous.select("work", "scene_no", F.col("translated").alias("previous"))
    done = fully_translated(F.col("previous"))
    done = done & structure_agrees(F.col("scene"), F.col("previous")) if same_structure else done
    return scenes.join(old, ["work", "scene_no"], "left").withColumn("reusable", F.coalesce(done | T.nothing_to_translate(F.col("scene")), F.lit(False)))


def wasteful(planned: DataFrame, least: int = 20, share: float = 0.5) -> DataFrame:
    """(work, scenes, done): works of which so much is done that doing all again would be a mistake."""
    rows = planned.groupBy("work").agg(F.count(F.lit(1)).alias("scenes"), F.sum(F.col("reusable").cast("long")).alias("done"))
    return rows.filter((F.col("scenes") >= least) & (F.col("done") >= F.col("scenes") * share))


def with_fallback(planned: DataFrame, results: DataFrame) -> DataFrame:
    """Scenes with `final`: the new result if it holds, else the previous one, else the source."""
    new = results.select("work", "scene_no", F.col("result").alias("new"))
    good = F.when(structure_agrees(F.col("scene"), F.col("new")) & ~T.is_refusal(F.col("new")), F.col("new"))
    return planned.join(new, ["work", "scene_no"], "left").withColumn("final", F.coalesce(good, "previous", "scene"))


def provided(rows: DataFrame, column: str, provider: Callable[[list[str]], list[str]], result: str = "result", per_batch: int = 3) -> DataFrame:
    """rows with `result` from an outside provider. Distinct inputs go once, in batches; a batch with too few answers is asked again one by one."""

    def answers(batches):
        for pdf in batches:
            texts, out = pdf["input"].tolist(), []
            for a in range(0, len(texts), per_batch):
                part = texts[a : a + per_batch]
                got = provider(part)
                out += got if len(got) == len(part) else [x[0] if len(x := provider([t])) == 1 else t for t in part]
            yield pd.DataFrame({"input": texts, result: out})

    distinct = rows.select(F.col(column).alias("input")).filter(F.col(column).isNotNull()).distinct()
    return rows.join(distinct.mapInPandas(answers, f"input string, {result} string"), rows[column] == F.col("input"), "left").drop("input")


def prompt(flags: Column, parts: dict[str, str], base: str) -> Column:
    """The base text and the prescription of each flag that has one."""
    known = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else F.create_map().cast("map<string,string>")
    return F.array_join(F.concat(F.array(F.lit(base)), F.array_compact(F.transform(flags, lambda f: known[f]))), "\n")


def merged_names(known: Column, found: Column) -> Column:
    """Two maps of names in one; known ones win."""
    return F.map_concat(F.map_filter(found, lambda k, v: ~F.map_contains_key(known, k)), known)


def accepted(old: DataFrame, new: DataFrame) -> DataFrame:
    """(work, accept): a change is kept unless leaks appear, structure falls or the residue grows by over 3; both have (work, leaks, percent, residue)."""
    o = old.select("work", F.col("leaks").alias("l0"), F.col("percent").alias("p0"), F.col("residue").alias("r0"))
    ok = (F.col("leaks") <= F.col("l0")) & (F.col("percent") >= F.col("p0")) & (F.col("residue") <= F.col("r0") + 3)
    return new.join(o, "work").select("work", ok.alias("accept"))


def without_echo(answer: Column) -> Column:
    """An answer without the labels of the task and blank lines it starts with, and the fences and blank lines it ends with."""
    lines = F.split(answer, "\n")
    blank = lambda x: T.trim(x) == ""
    first = F.array_position(F.transform(lines, lambda x: ~(blank(x) | T.follows(T.trim(x), "echoed label"))), F.lit(True)).cast("int")
    last = F.array_position(F.transform(F.reverse(lines), lambda x: ~(blank(x) | T.has(T.trim(x), "^```$"))), F.lit(True)).cast("int")
    kept = F.slice(lines, first, F.greatest(F.lit(0), F.size(lines) - last - first + 2))
    return F.when((first > 0) & (last > 0), F.array_join(kept, "\n")).otherwise("")


def asked(rows: DataFrame, provider: Callable[[list[str]], list[str | None]], attempts: int = 3) -> DataFrame:
    """(id, source, result, error) for rows (id, source): what a provider makes of each text, asked again where an answer does not hold.

    Each attempt is a round over what the rounds before left: answers that refuse give the source back; remarks of the translator are asked again each time, and another number of lines than the
    source has only after the first attempt. What still has remarks in the end has the error META_LEAK, and null for a text that the provider failed on. A text with nothing to translate is not asked.
    Answers are kept by checkpoint(), so no text is asked twice for one attempt.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def answers(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "answer": provider(pdf["source"].tolist())})

    full = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: ~T.is_blank(x)))
    idle = T.nothing_to_translate(F.col("source"))
    final = [rows.filter(idle).select("id", "source", F.col("source").alias("result"), F.lit(None).cast("string").alias("error"))]
    left = rows.filter(~idle).select("id", "source")
    for attempt in range(attempts):
        got = left.mapInPandas(answers, f"id {kind}, source string, answer string").withColumn("answer", F.when(F.col("answer").isNotNull(), without_echo(F.col("answer")))).checkpoint()
        refused, none = F.coalesce(T.is_refusal(F.col("answer")), F.lit(False)), F.col("answer").isNull()
        leaks = F.coalesce(F.exists(F.split("answer", "\n"), T.is_leak), F.lit(False))
        holds = ~none & (refused | (~leaks & ((full(F.col("answer")) == full(F.col("source"))) | F.lit(attempt > 0))))
        final.append(got.filter(holds).select("id", "source", F.when(refused, F.col("source")).otherwise(F.col("answer")).alias("result"), F.lit(None).cast("string").alias("error")))
        left = got.filter(~holds)
        if attempt == attempts - 1:
            final.append(left.select("id", "source", F.lit(None).cast("string").alias("result"), F.when(none, "NO_ANSWER").otherwise("META_LEAK").alias("error")))
        left = left.select("id", "source")
    out = final[0]
    for part in final[1:]:
        out = out.unionByName(part)
    return out


def scenes_of(text: Column) -> Column:
    """The scenes of an answer, cut at its headings; what stands before the first is its own part."""
    return F.filter(F.transform(F.split(text, r"(?m)^(?=#)"), T.trim), lambda x: x != "")


def translated_in_batches(scenes: DataFrame, provider: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(work, scene_no, result, status, error, batched) for scenes (work, scene_no, scene, batch): each batch is asked for as one text, and its answer divided again.

    An answer is taken if it has as many scenes as the batch and each agrees with its source in structure. All scenes of other batches, and those alone in theirs, are asked for one by one; there an answer
    of another structure is an error, and the scene keeps it for a later run.
    """
    key = F.struct("work", "batch")
    ordered = F.array_sort(F.collect_list(F.struct("scene_no", "scene")))
    batches = scenes.groupBy("work", "batch").agg(ordered.alias("own")).withColumn("n", F.size("own"))
    combined = batches.filter("n > 1").select(key.alias("id"), F.array_join(F.transform("own", lambda x: x["scene"]), "\n\n").alias("source"))
    answers = asked(combined, provider).select("id.work", "id.batch", scenes_of(F.col("result")).alias("parts"))
    both = batches.join(answers, ["work", "batch"]).filter(F.size("parts") == F.col("n")).select("work", "batch", F.explode(F.arrays_zip("own", "parts")).alias("x"))
    both = both.select("work", "batch", "x.own.scene_no", "x.own.scene", F.col("x.parts").alias("result")).withColumn("good", structure_agrees(F.col("scene"), F.col("result")))
    whole = both.groupBy("work", "batch").agg(F.min(F.col("good").cast("int")).alias("all_good")).filter("all_good = 1").select("work", "batch")
    together = both.join(whole, ["work", "batch"], "left_semi").select("work", "scene_no", "result", F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("batched")).checkpoint()

    alone = scenes.join(together, ["work", "scene_no"], "left_anti").select(F.struct("work", "scene_no").alias("id"), F.col("scene").alias("source"))
    one = asked(alone, provider).withColumn("good", structure_agrees(F.col("source"), F.col("result")) | F.coalesce(F.col("result") == F.col("source"), F.lit(False)))
    failed = F.when(F.col("error").isNull() & ~F.coalesce("good", F.lit(False)), "STRUCTURE").otherwise(F.col("error"))
    one = one.select("id.work", "id.scene_no", "result", F.when(failed.isNull(), "done").otherwise("error_translate").alias("status"), failed.alias("error"), F.lit(False).alias("batched"))
    return together.unionByName(one)
