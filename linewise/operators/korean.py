"""Korean scripts without marks: names from the cast list and from how lines end, and lines typed by them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import shapes as S
from ..functions import text as T
from .builders import compiled, flags
from .clean import frequent
from .names import Patterns

#: Endings and particles.
TOLD = r"(다|었다|한다|된다|든다|온다|간다|난다|린다|킨다|친다|뜬다)$"
SAID = r"(요|까|야|니|네|죠|자|래|군|데|지|어|아|만)[.?!…~]*$"
POLITE = r"(니다|니까|나요|가요)$"
PARTICLE_END = r"[은는이가을를의도와과로게서고며에]$"
PARTICLE_START = r"^[은는이가을를의도와과에서로만]"
PARTICLES = r"^[은는이가을를의도와과에서로만보다처럼부터까지]"
SOUND = r"\((?:o\.?s|v\.?o|n\.?a|f|e|filter|소리|필터)[^)]*\)"
VOICE = r"^(.{1,12}?)\s*(?:더빙)?\s*(?:목)?소리\s*>\s*(.*)$"
SOUND_END = r"\s*(?:의)?\s*(?:더빙)?\s*(?:목)?소리$"
DIRECTION = r"^(INSERT|CUT TO|FADE (IN|OUT)|DISSOLVE|F\.?O\.?|F\.?I\.?|C\.?U\.?|O\.?L\.?|MONTAGE|TITLE|CREDIT)\b"
SCENE = r"^#\s*(\d{1,3})\.?\s*(.*)$"
#: A first word with something after it, in one line; its blanks are those of ASCII.
WORD = r"^[가-힣A-Za-z0-9]{2,8}"
LEAD = WORD + r"[ \t\n\x0B\f\r]+"
FIRST = LEAD + r"[^ \t\n\x0B\f\r].*$"
CLOSING = r"[\s.!?…\"'’”)~]+$"
#: The characters of CLOSING and what may stand after it for Java's engine; so many characters are looked at for them first.
CLOSING_MARKS, TAIL = T.BLANKS + "\x85.!?…\"'’”)~", 40


def title_runs(lines: DataFrame, least: int = 3) -> DataFrame:
    """(work, key, n): runs of Chinese characters, as a title stamped on each page, that a work has `least` times."""
    runs = lines.select("work", F.explode(F.regexp_extract_all("text", F.lit(T.rx(r"[一-鿿][一-鿿\s]{2,20}")), F.lit(0))).alias("run"))
    return frequent(runs, T.trim(F.col("run")), least)


def without_title_runs(lines: DataFrame, least: int = 3) -> DataFrame:
    """Lines without those titles where other text stands beside them."""
    stamps = title_runs(lines, least).groupBy("work").agg(F.collect_set("key").alias("stamps"))  # few a work
    rows = lines.join(stamps, "work", "left")
    cut = F.aggregate("stamps", F.col("text"), lambda acc, k: F.when(F.contains(acc, k) & (T.trim(acc) != k), F.replace(acc, k, F.lit(""))).otherwise(acc))
    return rows.withColumn("text", F.regexp_replace(F.coalesce(cut, "text"), r"[ \t]+$", "")).drop("stamps")


def is_told(text: Column) -> Column:
    """Whether a line ends like narration. Only a line that ends in 다, closing marks aside, can: others are not asked."""
    tail = F.rtrim(F.substring(text, -TAIL, TAIL), F.lit(CLOSING_MARKS))
    t = T.sub(F.when((tail == "") | tail.endswith("다"), text), CLOSING)  # a tail of marks alone does not say
    return F.coalesce(T.has(t, TOLD) & ~T.has(t, POLITE), F.when(text.isNotNull(), False))


def _bare(name: Column) -> Column:
    cut = T.trim(T.sub(name, SOUND_END))
    return F.when(F.length(cut) >= 1, cut).otherwise(name)


def names_by_endings(lines: DataFrame, least: int = 2) -> DataFrame:
    """(work, name, n): first words of lines that end like speech, `least` times; those that end in a particle are no names."""
    rows = lines.select("work", _first_word(T.trim(F.col("text"))).alias("name")).filter("name IS NOT NULL")
    return rows.groupBy("work", "name").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & ~T.has(F.col("name"), PARTICLE_END))


def _first_word(text: Column) -> Column:
    """The first word of a line that ends like speech and goes on like it, or null; the lines of a batch together."""
    shape, start, told, said = (P.rx(p) for p in (FIRST, PARTICLE_START, TOLD, SAID))
    closing = [P.rx(p) for p in (r"\([^)]*\)\s*$", CLOSING)]

    def of(texts: pa.Array) -> pa.Array:
        asked = pc.fill_null(pc.match_substring_regex(texts, shape), False)
        own = texts.filter(asked)
        rest = pc.replace_substring_regex(own, LEAD, "", max_replacements=1)
        tail = rest
        for pattern in closing:
            tail = pc.replace_substring_regex(tail, pattern, "")
        other = pc.or_(pc.or_(pc.match_substring_regex(rest, start), pc.starts_with(rest, ",")), pc.match_substring_regex(tail, told))
        speech = pc.and_not(pc.match_substring_regex(tail, said), other)
        first = pc.struct_field(pc.extract_regex(own, f"(?P<first>{WORD})"), "first")
        return pc.replace_with_mask(pa.nulls(len(texts), pa.string()), asked, pc.if_else(speech, first, None).cast(pa.string()))

    return F.arrow_udf(of, "string")(text)


class ScriptReader:
    """A table function: the lines of a work in order to (work, line_no, kind, speaker, said, text), from the first scene on.

    First the names are gathered from all lines: of the cast list before the first scene, of remarks on voices, and first words that often go before speech. Then one pass types the lines: those that start with the longest
    name that fits, and those that go on as a voice until something else begins.
    """

    def __init__(self):
        self.lines: list = []

    def eval(self, line) -> None:
        self.lines.append(line)

    def names(self, first: int) -> tuple[Patterns, Patterns]:
        """(all names, those of the cast list)."""
        cast = {n for r in self.lines[:first] if r.cast for n in (r.cast, r.cast.split(" ")[0]) if len(n) >= 2}
        body = self.lines[first:]
        often = Counter(r.first_word for r in body if r.first_word)
        guessed = {n for n, times in often.items() if times >= 2 and not _NO_NAME.search(n)}
        return Patterns(cast | {r.heard for r in body if r.heard and len(r.heard) >= 2} | guessed), Patterns(cast)

    def terminate(self) -> Iterator[tuple]:
        first = next((i for i, r in enumerate(self.lines) if r.scene), None)
        if first is None:
            return
        names, cast = self.names(first)
        voice, on = None, False  # whose voice the lines since the last heading, blank or speaker have, and whether it still goes on
        for r in self.lines[first:]:
            speaker, said = (None, None) if r.t == "" or r.scene or r.voice is not None else spoken_by(r.t, names.at_start(r.t))
            if r.t == "" or r.scene or r.voice is not None or speaker:
                voice, on = r.voice if r.t != "" and not r.scene else None, True
                kind = "blank" if r.t == "" else "scene" if r.scene else "voice" if r.voice is not None else "speech"
                if kind == "voice":
                    speaker, said = f"{r.voice} (소리)", r.words
                if kind != "blank":
                    yield r.work, r.line_no, kind, speaker, said, r.heading if r.scene else r.t
                continue
            on = on and not r.stops and not r.told and (r.asks or not any(n != voice and _about(n, r.t) for n in cast.within(r.t)))
            yield (r.work, r.line_no, "voiced", None, r.t, r.t) if voice is not None and on else (r.work, r.line_no, "other", None, None, r.t)


_NO_NAME, _PARTICLES, _AGE, _CLOSING, _TOLD, _POLITE = (compiled(p) for p in (PARTICLE_END, PARTICLES, r"^\(\s*\d{1,2}\s*(세|살)", CLOSING, TOLD, POLITE))
_OF_VOICE, _REMARK = re.compile(r"(?:의\s*)?(?:더빙)?(?:목)?소리(?![가-힣A-Za-z0-9_])", re.A), re.compile(SOUND, re.I | re.A)


def spoken_by(text: str, name: str | None) -> tuple[str | None, str | None]:
    """(speaker, what is said) of a line that starts with a name, or two nulls where neither speech follows."""
    if name is None:
        return None, None
    after = text[len(name) :]
    rest = after.strip(T.BLANKS)
    sound = m[0] if (m := _OF_VOICE.match(rest)) else ""
    rest_of = rest[len(sound) :].strip(T.BLANKS)
    remark = m[0] if (m := _REMARK.match(rest_of)) else ""
    said = rest_of[len(remark) :].strip(T.BLANKS)
    end = _CLOSING.sub("", said)
    told = _TOLD.search(end) and not _POLITE.search(end)
    if after == "" or after.startswith(",") or _PARTICLES.search(after) or _AGE.search(rest) or said == "" or told:
        return None, None
    return name + (f" {remark}" if remark else " (소리)" if sound else ""), said


def _about(name: str, text: str) -> bool:
    """Whether a text says something about a name, not to it."""
    return re.search(re.escape(name) + r"(?:[의이가은는을를]|\s+[가-힣]|\.$)", text, re.A) is not None


def korean_lines(lines: DataFrame) -> DataFrame:
    """(work, line_no, part, type, text): scenes, speakers, speech, remarks and narration of Korean scripts from the first scene on.

    A line is speech if it starts with a speaker's name (the longest that fits) and neither a particle follows nor narration. After a `…소리>` line the lines go
    on as that voice until a blank line or one that reads like narration or speaks about another of the cast. The lines of a work go through one ordered pass, with one shuffle.
    """
    # a pattern is asked where the signs are that it needs
    lines, t = lines.select("work", "line_no", F.coalesce(T.trim(F.col("text")), F.lit("")).alias("t")), F.col("t")
    number = lines.schema["line_no"].dataType.simpleString()
    voiced = F.when(F.contains(t, F.lit("소리")) & F.contains(t, F.lit(">")), t)
    remarked = F.regexp_extract(F.when(F.contains(t, F.lit("(")), t), rf"(?i)^([가-힣A-Za-z0-9]{{2,10}})\s*{SOUND}", 1)
    heard = F.when(F.coalesce(remarked, F.lit("")) != "", remarked).otherwise(S.voice_name(voiced))
    scene = F.when(t.startswith("#"), t)
    heading = F.concat(F.lit("# "), F.regexp_extract(scene, T.rx(SCENE), 1), F.lit(". "), T.trim(F.regexp_extract(scene, T.rx(SCENE), 2)))
    dashed = F.when(F.contains(t, F.lit("-")) | F.contains(t, F.lit("–")), t)
    cast = T.trim(F.regexp_extract(dashed, r"^([가-힣A-Za-z0-9 ]{1,12}?)\s*[-–]\s*\S", 1))
    rows = lines.select(
        "work", F.col("line_no").cast("long").alias("line_no"), t.alias("t"), cast.alias("cast"), _bare(heard).alias("heard"), _first_word(t).alias("first_word"), S.voice_name(voiced).alias("voice"),
        F.regexp_extract(voiced, T.rx(VOICE), 2).alias("words"), heading.alias("heading"),
        *flags(scene=T.has(scene, SCENE), told=is_told(t), stops=T.has(t, DIRECTION, True) | T.has(t, r"^[<\[]"), asks=T.has(F.substring(t, -3, 3), "[?!~]$")),
    )
    kind = lines.schema["work"].dataType.simpleString()
    read = F.udtf(ScriptReader, returnType=f"work {kind}, line_no long, kind string, speaker string, said string, text string")
    rows = read(rows.asTable().partitionBy("work").orderBy("line_no"))

    piece = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))

    def spoken(text: Column) -> Column:
        """What is said, and the remarks before and after it."""
        parts = S.speech_parts(text)
        one = lambda kind, c, before, after: F.when(c.isNotNull(), piece(kind, F.concat(F.lit(before), T.trim(c), F.lit(after))))
        return F.array_compact(F.array(one("paren", parts["before"], "(", ")"), one("dialogue", parts["said"], "- ", ""), one("paren", parts["after"], "(", ")")))

    none = F.array().cast("array<struct<type:string,text:string>>")
    speaker = F.array(piece("character", F.concat(F.lit("@"), "speaker")))
    said = F.when(T.trim(F.col("said")) != "", spoken(F.col("said"))).otherwise(none)
    pieces = (
        F.when(F.col("kind") == "scene", F.array(piece("scene", F.col("text")))).when(F.col("speaker").isNotNull(), F.concat(speaker, said))
        .when(F.col("kind") == "voiced", spoken(F.col("said"))).otherwise(F.array(piece("action", F.col("text"))))
    )
    return rows.select("work", F.col("line_no").cast(number).alias("line_no"), F.posexplode(pieces).alias("part", "p")).select("work", "line_no", "part", "p.type", "p.text")
