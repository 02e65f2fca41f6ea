"""Many rules at once over Arrow batches: each by the automata of Arrow's own patterns, in time that grows with the text alone."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import RULES
from .text import BLANK

#: What ends a line for Java's engine: its dot takes none of these, and its end of text may have one after it.
_ENDS = r"\n\r\x{85}\x{2028}\x{2029}"
#: Tests beside the rules: patterns of which all are found, and those of which none is.
PLAIN = {
    "set off": ((r"^[#@]",), ()),
    "korean": (("[가-힣]",), ()),
    # a name in capitals may have two small letters in 28, others stand in brackets at its end
    "few small letters": ((r"^[^a-z]*(?:[a-z][^a-z]*){0,2}(?:\([^)]*\)\s*)?$",), ()),
    "dashed": ((r"\s[-–—]\s",), ()),
    "untranslated": ((r"[A-Za-z]" + r"(?:[^A-Za-z]*[A-Za-z]){9}",), ("[가-힣]",)),
}


def rx(pattern: str, ignore_case: bool = False) -> str:
    """A pattern as text.rx means it, for Arrow: no case folding but of ASCII letters, Unicode blanks, ASCII word edges. No lookaround."""
    tokens = re.findall(r"(?s)\(\?(?:i\)|i:|:|<?[=!])|\\.|.", pattern)
    out, inside, ignore, k = [], False, [ignore_case], 0
    both = lambda c: c + c.swapcase() if c.isascii() and c.isalpha() else c
    while k < len(tokens):
        token = tokens[k]
        k += 1
        if inside:
            if token == "]":
                inside = False
                out.append(token)
            elif k + 1 < len(tokens) and tokens[k] == "-" and tokens[k + 1] != "]":
                low, high = token, tokens[k + 1]
                k += 2
                out.append(f"{low}-{high}")
                if ignore[-1] and low.isascii() and low.isalpha():
                    out.append(f"{low.swapcase()}-{high.swapcase()}")
            elif token == r"\s":
                out.append(BLANK)
            elif token.startswith("(?"):
                out.append(token)  # two signs of a class
            else:
                out.append(r"\[" if token == "[" else both(token) if ignore[-1] else token)
        elif token == "(?i)":
            ignore[-1] = True
        elif token == "(?i:":
            ignore.append(True)
            out.append("(?:")
        elif token in ("(", "(?:"):
            ignore.append(ignore[-1])
            out.append("(?:")
        elif token.startswith("(?"):
            raise ValueError(f"{token} in {pattern}")
        elif token == ")":
            ignore.pop()
            out.append(token)
        elif token == "[":
            inside = True
            if k < len(tokens) and tokens[k] == "^":
                token += tokens[k]
                k += 1
            out.append(token)
        else:
            other = {r"\s": f"[{BLANK}]", r"\S": f"[^{BLANK}]", ".": f"[^{_ENDS}]", "$": rf"(?:\r\n|[{_ENDS}])?\z"}.get(token)
            out.append(other or (f"[{both(token)}]" if ignore[-1] and token.isascii() and token.isalpha() else token))
    return "".join(out)


def _parts(name: str) -> tuple[list[str], list[str]]:
    """The patterns of a rule or test that must all be found, and those of which none may."""
    if name in PLAIN:
        every, never = PLAIN[name]
        return [rx(p) for p in every], [rx(p) for p in never]
    rule = RULES[name]
    some = ["|".join(f"(?:{rx(p)})" for p in rule.some)] if rule.some else []
    return [rx(p) for p in rule.every] + some, [rx(p) for p in rule.never]


def marks(text: Column, names: tuple[str, ...]) -> Column:
    """A number with a bit for each rule or test, in their order, that the text follows; null for null. See holds()."""
    parts = [_parts(name) for name in names]

    def of(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), np.int64)
        for k, (every, never) in enumerate(parts):
            left = np.arange(len(texts))
            for pattern, wanted in (*((p, True) for p in every), *((p, False) for p in never)):
                if len(left):
                    own = texts if len(left) == len(texts) else texts.take(pa.array(left))
                    left = left[pc.fill_null(pc.match_substring_regex(own, pattern), False).to_numpy(zero_copy_only=False) == wanted]
            out[left] |= 1 << k
        return pa.array(out, mask=texts.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(of, "long")(text)


def holds(bits: str, names: tuple[str, ...], name: str) -> Column:
    """Whether a column of marks() has the bit of that name."""
    return F.col(bits).bitwiseAND(F.lit(1 << names.index(name))) != 0


def replaced(text: Column, patterns: tuple[str, ...], to: str = " ") -> Column:
    """The text with what each of the patterns finds replaced, one pattern after the other; null where none is found."""
    own = [rx(p) for p in patterns]
    some = "|".join(f"(?:{p})" for p in own)

    def of(texts: pa.Array) -> pa.Array:
        hit = pc.fill_null(pc.match_substring_regex(texts, some), False)
        found = texts.filter(hit)
        for pattern in own:
            found = pc.replace_substring_regex(found, pattern, to)
        return pc.replace_with_mask(pa.nulls(len(texts), texts.type), hit, found)

    return F.arrow_udf(of, "string")(text)
