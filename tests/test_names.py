"""Names and marks found by one automaton, against versions that compare every line with every pattern."""

import random
import re
from collections import Counter

from linewise.operators import lines as L
from linewise.operators import names
from linewise.plans import screen_queries
from linewise.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(spark, text, work="w"):
    return L.to_lines(spark.createDataFrame([(work, text)], "id string, text string"), "id", "text")


def texts_of(rows):
    return [x.text for x in rows.orderBy("line_no").collect()]


def test_patterns_are_found_as_by_comparing_with_all():
    r = random.Random(1)
    for _ in range(300):
        own = {"".join(r.choice("ab ") for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(6))}
        text, found = "".join(r.choice("ab ") for _ in range(r.randrange(12))), names.Patterns(own)
        assert found.within(text) == {p for p in own if p in text} and (text in found) == (text in own)
        assert found.at_start(text) == max((p for p in own if text.startswith(p)), key=len, default=None)
        assert found.at_end(text) == max((p for p in own if text.endswith(" " + p)), key=len, default=None)
        out, at = "", 0
        while at < len(text):
            here = max((p for p in own if text.startswith(p, at)), key=len, default=None)
            out, at = (out + "_", at + len(here)) if here else (out + text[at], at + 1)
        assert found.cut_out(text, "_") == out


def test_cues_in_speech_by_hand(spark):
    rows = rows_of(spark, "@JAMES\n@SR. JAMES (V.O.)\n@X\n- JAMES\n- It ends. SR. JAMES\n- I met SR. JAMES\n- so JAMES\n- “Go.” JAMES\n- (low) JAMES\nJAMES\n- it is. X\n-  end!  JAMES ")
    assert [(x.line_no, x.speech, x.cue) for x in names.merged_cues(rows).orderBy("line_no").collect()] == [
        (3, None, "JAMES"), (4, "- It ends.", "SR. JAMES"), (7, "- “Go.”", "JAMES"), (8, "- (low)", "JAMES"), (11, "- end!", "JAMES"),
    ]
    assert texts_of(names.with_cues_split(rows))[3:8] == ["@JAMES", "- It ends.", "", "@SR. JAMES", "- I met SR. JAMES"]
    assert names.merged_cues(rows_of(spark, "- JAMES\nx")).count() == 0 and names.merged_cues(rows.limit(0)).count() == 0


def test_a_long_work_is_several_parts(spark, monkeypatch):
    text = "\n".join(["@ANN", "- It ends. ANN"] * 30)
    want = [tuple(x) for x in names.merged_cues(rows_of(spark, text)).orderBy("line_no").collect()]
    monkeypatch.setattr(names, "PART", 7)
    assert [tuple(x) for x in names.merged_cues(rows_of(spark, text)).orderBy("line_no").collect()] == want and len(want) == 30


def plain_watermarks(lines):
    """The lines of one work without stamps and addresses, line by line, by comparing with every stamp and mark."""
    shape = re.compile(r"^©?\s*\d{0,4}\s*[A-Z][A-Za-z0-9&.•' -]{2,60}[-–—]\s*[A-Z][A-Z ,.'-]{4,60}$")
    n = Counter()
    for line in lines:
        if shape.search(line.strip()):
            n[line.strip()] += 1
        else:
            n.update([s for s in n if s in line.strip()])
    stamps = [s for s, times in n.items() if times >= 3]
    token = re.compile(r"\S*https?://\S+")
    key = lambda t: t[t.index("http") :][:40]
    marks = {m for m, times in Counter(key(t) for line in lines for t in token.findall(line)).items() if times >= 5}
    out = []
    for line in lines:
        for s in stamps:
            if line.strip() == s:
                line = ""
            elif s in line:
                line = re.sub(r"\s{2,}", " ", line.replace(s, "")).strip()
        if stamps or marks:
            line = re.sub("[ \t]{2,}", " ", token.sub(lambda m: "" if key(m[0]) in marks else m[0], line))
        if marks:
            line = line.rstrip(" \t")
            mark, told = re.match(r"(\s*(?:# |@|- )?)(.*)", line).groups()
            told = told.rstrip()
            again = told.find(told[:20], 1) if len(told) >= 40 else -1
            line = mark + told[again:] if again >= 20 else line
        if (stamps or marks) and re.fullmatch(r"[#@-]\s*", line.strip()):
            continue
        if (stamps or marks) and line == "" and out and out[-1] == "":
            continue
        out.append(line)
    return out


def test_watermarks_by_hand(spark):
    stamp, address = "© 2013 Fine Books - A GREAT TITLE", "/9https://site.example/some/very/long/path/to/a/script/page"
    text = f"- so {stamp} he says\n{stamp}\n\n{stamp}\n- and {stamp} on\nA line that begins here {address}1 A line that begins here and goes on.\n" + f"@ {address}\n" * 4 + "see https://other.example/x"
    got = texts_of(names.without_watermarks(rows_of(spark, text)))
    assert got == ["- so he says", "", "- and on", "A line that begins here and goes on.", "see https://other.example/x"] == plain_watermarks(text.split("\n"))
    assert texts_of(names.without_watermarks(rows_of(spark, "a\n\n\n@\nb"))) == ["a", "", "", "@", "b"]


def test_registered_watermarks_over_a_whole_table(spark):
    works = {}
    for x in screen_queries.watermarked_lines(spark, SF).orderBy("work", "line_no").collect():
        works.setdefault(x.work, []).append(x.text)
    got = {}
    for x in QUERIES["without_watermarks"](spark, SF).orderBy("work", "line_no").collect():
        got.setdefault(x.work, []).append(x.text)
    want = {w: plain_watermarks(own) for w, own in works.items()}
    assert got == {w: own for w, own in want.items() if own} and any(want[w] != works[w] for w in works)
