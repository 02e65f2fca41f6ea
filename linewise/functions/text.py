"""Column expressions over lines of text. All but collapse_repeats are built-in functions alone, so plans that use them stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import folding
from .rules import ERRORS, RULES, TIMES, TRANSIENT

#: White space as the Unicode-aware engines see it; Java's \\s is ASCII alone.
BLANK = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: A word boundary between ASCII word characters and others; Java's \\b also sees accented letters as words.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: The same before words, which start with such a character.
BEFORE = r"(?<![A-Za-z0-9_])"


def rx(pattern: str, ignore_case: bool = False) -> str:
    """A pattern with Unicode blanks (\\s, \\S) and ASCII word edges (\\b), for Java's engine."""
    out, inside = ["(?i)" if ignore_case else ""], False
    pattern = re.sub(r"\\b(?=\([A-Za-z0-9]|[A-Za-z0-9])", "\0", pattern)  # alternatives after an edge start with words throughout
    for token in re.findall(r"(?s)\\.|.", pattern):
        if token == "\0":
            out.append(BEFORE)
            continue
        if token == r"\s":
            out.append(BLANK if inside else f"[{BLANK}]")
        elif token == r"\S":
            out.append(f"[^{BLANK}]")
        elif token == r"\b":
            out.append(EDGE)
        elif token == "[":
            out.append(r"\[" if inside else "[")  # Java nests classes, others do not
            inside = True
        else:
            inside = inside and token != "]"
            out.append(token)
    return "".join(out)


def has(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(rx(pattern, ignore_case))


def count_of(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.regexp_count(text, F.lit(rx(pattern, ignore_case)))


def sub(text: Column, pattern: str, to: str = "", ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, rx(pattern, ignore_case), to)


#: The characters of BLANK: cutting them off the ends needs no pattern.
BLANKS = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(text: Column) -> Column:
    """Without Unicode blanks at either end."""
    return F.btrim(text, F.lit(BLANKS))


def rtrim(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return trim(text) == ""


def indent(text: Column) -> Column:
    """Leading spaces."""
    return F.length(text) - F.length(F.ltrim(text))


def word_count(text: Column) -> Column:
    return count_of(text, r"\S+")


def hangul(text: Column) -> Column:
    return count_of(text, "[가-힣]")


def latin(text: Column) -> Column:
    return count_of(text, "[A-Za-z]")


def upper_ratio(text: Column) -> Column:
    """Capitals among ASCII letters; null without letters."""
    return count_of(text, "[A-Z]") / F.nullif(latin(text), F.lit(0))


def signature(text: Column) -> Column:
    """Lower case, digits and punctuation as blanks, blanks squeezed: what a running header keeps from page to page."""
    plain = sub(F.lower(trim(text)), r"\d+", " ")
    return trim(sub(sub(plain, "[\\[\\]().,/'\"“”\\-–—:!?]", " "), r"\s+", " "))


def comparable(text: Column) -> Column:
    """Letters and numbers alone, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def duplicate_key(text: Column) -> Column:
    """A key under which spellings of one title agree: lower case, without marks, articles at the start, or a year in brackets."""
    plain = sub(F.lower(text), r"\(\d{4}\)", " ")
    return sub(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "), r"^\s*(the|a|an)\s+|\s+")


def kind(text: Column) -> Column:
    """S heading, C cue, D dialogue, P parenthetical, A anything else, by the marker that a line starts with."""
    t = trim(text)
    return (
        F.when(t.startswith("#"), "S").when(t.startswith("@"), "C").when(t.startswith("- "), "D")
        .when(t.startswith("(") & t.endswith(")"), "P").otherwise("A")
    )


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring characters, blanks aside."""
    plain, two = sub(text, r"\s"), F.lit("(?s)..")
    return F.array_union(F.regexp_extract_all(plain, two, F.lit(0)), F.regexp_extract_all(F.substring(plain, 2, 1 << 30), two, F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def collapse_repeats(text: Column) -> Column:
    """Runs of three or more copies of six characters or more become one, until nothing changes; a tail of one digit only where a run did."""
    out = F.pandas_udf(folding.folded_all, "string")(text)  # null where nothing changes
    return F.when(out.isNotNull(), F.regexp_replace(out, rx(r"(\d)\1{2,}\s*$"), "$1")).otherwise(text)


def round_half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5))


def estimated_tokens(text: Column) -> Column:
    return round_half_up(F.length(text) / 3).cast("long")


# --- what a line is, by the rules of rules.py -------------------------------------------------------------------------------------


def has_any(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether one of the patterns is found: one search for those that ignore case, and one for the others."""
    plain = [p for p in patterns if not p.startswith("(?i)")]
    loose = [p[4:] for p in patterns if p.startswith("(?i)")]
    found = [has(text, "|".join(f"(?:{p})" for p in own), ignore) for own, ignore in ((plain, False), (loose, True)) if own]
    return found[0] if len(found) == 1 else found[0] | found[1]


def follows(text: Column, name: str) -> Column:
    """Whether the text follows the rule of that name."""
    rule, out = RULES[name], F.lit(True)
    for pattern in rule.every:
        out = out & has_any(text, (pattern,))
    if rule.some:
        out = out & has_any(text, rule.some)
    if rule.never:
        out = out & ~has_any(text, rule.never)
    return out


def capitals(text: Column, least: int, share: float) -> Column:
    """Whether a text has `least` ASCII letters, and that share of them are capitals."""
    return (latin(text) >= least) & (F.coalesce(upper_ratio(text), F.lit(0.0)) >= share)


def is_slug_line(text: Column, times: str = TIMES, ignore_case: bool = True, shortest: int = 5) -> Column:
    """`PLACE - TIME` in capitals: sections between dashes, of which the last names a time of day."""
    s = trim(text)
    last = F.element_at(F.split(s, rx(r"\s[-–—]\s")), -1)
    return F.length(s).between(shortest, 70) & has(s, r"\s[-–—]\s") & capitals(s, 3, 0.85) & has(last, rf"\b({times})\b", ignore_case)


def is_heading(text: Column) -> Column:
    return follows(text, "heading") | is_slug_line(text)


def normal_heading(text: Column) -> Column:
    """`# ` and the heading without scene numbers at its ends or stuck to the time of day."""
    h = trim(sub(sub(text, r"^[A-Z]{0,2}\d+\.?\s+"), r"\s+[A-Z]{0,2}\d+\.?$"))
    return F.concat(F.lit("# "), trim(sub(h, rf"\b({TIMES})\s*\d{{1,4}}\s*$", "$1", True)))


def is_cue(text: Column) -> Column:
    """A line that names a speaker: short, in capitals, no heading, transition, label, set or sentence."""
    t = trim(text)
    core = trim(sub(sub(t, r"\s*\([^)]*\)\s*$"), r"[:：]\s*$"))
    return F.length(core).between(2, 28) & (word_count(core) <= 4) & capitals(core, 2, 0.9) & ~is_heading(t) & ~follows(core, "no speaker") & ~follows(core, "set")


def as_cue(text: Column) -> Column:
    return F.concat(F.lit("@"), trim(sub(trim(text), r"[:：]\s*$")))


def cue_name(text: Column) -> Column:
    """The name of a cue line: without the marker and what stands in brackets."""
    return trim(F.split(sub(trim(text), "^@"), r"\(").getItem(0))


def is_meta(text: Column) -> Column:
    """A remark about the work itself rather than the text."""
    return follows(text, "meta")


def is_leak(text: Column) -> Column:
    """What a model says about its own task instead of doing it; in speech and cues only what no script would say."""
    s = trim(text)
    return (F.length(s) > 0) & (follows(s, "leak") | follows(s, "leak outside speech"))


def error_class(message: Column) -> Column:
    """What kind of failure a message tells of; `unknown` without one."""
    m, out = F.lower(message), F.when(F.coalesce(message, F.lit("")) == "", "unknown")
    for name, pattern in ERRORS:
        out = out.when(has(m, pattern), name)
    return out.otherwise("other")


def is_transient(message: Column) -> Column:
    """Whether a failed call is worth another try."""
    return F.coalesce(has(message, TRANSIENT, True), F.lit(False))


#: Fixed value: phrases that ask for input.
REFUSAL = (
    r"(붙여넣어?\s*주|올려\s*주|보내\s*주|제공해\s*주|번역해\s*드리|번역을?\s*시작하겠|번역하겠습니다|실제\s*(각본|씬|스크립트|내용)"
    r"|텍스트를?\s*(주|입력|붙여|제공)|paste|provide[^\n]*(script|text)|no (screenplay|script) content)"
)


def is_refusal(text: Column) -> Column:
    """A whole answer that asks for input instead of giving any: no marked line outside code fences, and a telling phrase."""
    bare = F.regexp_replace(trim(text), r"(?s)```.*?```", "")
    return ~has(bare, r"(^|\n)\s*[#@]") & has(bare, REFUSAL, True)


def nothing_to_translate(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: has(x, r"^#\s*([0-9]+[A-Z]?\s*)?(OMIT\w*|DELETED)?\s*([0-9]+[A-Z]?)?\s*$", True))


def is_marker(text: Column) -> Column:
    return follows(text, "marker")


def is_header_shape(text: Column) -> Column:
    return follows(text, "header")


def is_sure_boilerplate(text: Column) -> Column:
    """A continuation mark, or a header with revision number and date, or with title and page."""
    return follows(text, "sure header")


def is_untranslated(text: Column) -> Column:
    return (latin(text) >= 10) & ~has(text, "[가-힣]")


def is_structural(text: Column) -> Column:
    return follows(text, "shot or title")


def is_suspicious_cue(text: Column) -> Column:
    return follows(text, "mistagged cue")


def looks_like_action(text: Column) -> Column:
    """Narration within dialogue: a named subject and a narrative ending, and nothing that only speech has."""
    return follows(trim(text), "narration")


def has_page_number(text: Column) -> Column:
    """A heading that ends in a page number, years aside."""
    return follows(text, "page number at the end")


def is_transitionish(text: Column) -> Column:
    return follows(text, "transition start") | is_header_shape(text)


def looks_foreign(text: Column) -> Column:
    return follows(text, "foreign")


def looks_like_title(text: Column) -> Column:
    return follows(text, "title")


def text_side(text: Column) -> Column:
    """`translated` where a heading or a tenth of the characters is Korean, else `formatted`."""
    return F.when(has(text, r"(?m)^#\s*(내부|외부|삽입)") | (hangul(text) / F.nullif(F.length(text), F.lit(0)) > 0.1), "translated").otherwise("formatted")


def looks_misread(token: Column) -> Column:
    """A token no reader would write: without any vowel (y is one), five consonants in a row, or capitals inside."""
    return (F.length(token) >= 3) & (~has(token, "[aeiouyAEIOUY]") | has(token, "[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]{5}") | has(token, "[a-z][A-Z]"))


def is_furniture(text: Column) -> Column:
    """Page numbers and continuation marks."""
    return has(text, r"^\(?\d{1,4}[A-Z]?\.?\)?$") | has(text, r"^\(?(CONTINUED|CONT'D|MORE)\)?:?(\s*\(?\d+\)?)?$", True)


def initial_consonant(text: Column) -> Column:
    """Number (0 to 18) of the first consonant of a Hangul syllable, else null."""
    code = F.ascii(text)
    return F.when(code.between(44032, 55203), F.floor((code - 44032) / 588).cast("int"))


def year_of(name: Column, *texts: Column) -> Column:
    """The first year in a name, else near a copyright or draft mark of the texts, else the first in them."""
    year = r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"
    first = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    near = r"(?is)(?:©|copyright|draft|revision).{0,30}?" + year
    return F.coalesce(first(name, year), *[first(t, near) for t in texts], *[first(t, year) for t in texts])
