"""Queries against their SQL over made-up documents, for lines that the small tables do not hold."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linewise.functions import folding
from linewise.functions import patterns as P
from linewise.functions import text as T
from linewise.functions.rules import HEADERS, RULES
from linewise.operators import clean, korean
from linewise.plans.queries import ORACLES, QUERIES


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query gives the rows of its SQL over documents of these ids and texts."""

    def check(name: str, docs: dict) -> bool:
        spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        got = QUERIES[name](spark, str(tmp_path))
        found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
        return bool(found) and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, found))

    return check


#: A cue is rendered where (doc_id + line_no) mod 12 is 2: here of lines without a letter.
NO_LETTERS = {1: "a line\n7 8 9\nan other", 2: "...\nb", 12: "x y\n\n\u4e2d"}


def test_a_cue_without_a_name_stays(agrees):
    assert agrees("cleaned_reading", NO_LETTERS)


def test_an_item_without_text_keeps_its_line(agrees):
    assert agrees("rows_by_height", NO_LETTERS)


def test_a_line_of_one_letter_holds_one_run():
    codes = np.array([ord("a")] * 3000 + [folding.END] + [ord(c) for c in "abcdefgh" * 4] + [folding.END + 1], np.uint32)
    assert list(folding.runs(codes)) == [(0, 6, 2994), (3001, 8, 3025)]
    assert folding.folded(["a" * 20 + "\r\n" + "abcdefgh" * 4, "abcdef" * 2, ""]) == ["a" * 8 + "\r\nabcdefgh", None, None]


ODD_LINES = [
    "", "# INT. ROOM - DAY", "CUT TO:", "Pink Revised 07/15/2016 12A.", "pin\u212a revised 1/2/03 4", "\u017fure, here it is", "SURE\rno", "(CONTINUED)\x85", "here\u2019s the script:", "Here is the format\u2028",
    "F\u00dcR uns", "f\u00fcr uns", "\u00a0sure thing", "@MARY -", "@ A B C D", "- (\ubc88\uc5ed \uc2dc\uc791.", "\ubbfc\uc218\uac00 \uac04\ub2e4.", "\"A\"", "OMITTED (NOW 12)", "abcdefghij", "abcdefghi1", "12.", "Sc. 4 Pink 1/2/03", "a - b",
]


def test_rules_asked_together_are_the_rules(spark):
    names = tuple(RULES)
    rows = spark.createDataFrame([(t,) for t in [*ODD_LINES, None]], "t string").withColumn("marks", P.marks(F.col("t"), names))
    other = [F.coalesce(T.follows(F.col("t"), n) != P.holds("marks", names, n), F.lit(False)).alias(n) for n in names]
    for part in (other[:20], other[20:40], other[40:]):
        assert not [r for r in rows.select("t", *part).collect() if any(r[1:])]


def test_headers_replaced_together_are_those_replaced_one_by_one(spark):
    t = one = F.col("t")
    for pattern in HEADERS:
        one = T.sub(one, pattern, " ")
    rows = spark.createDataFrame([(t,) for t in ODD_LINES], "t string").withColumn("got", P.replaced(t, HEADERS))
    assert [r.t for r in rows.withColumn("one", one).filter(F.coalesce("got", "t") != F.col("one")).collect()] == []
    assert rows.filter("got is null").count() < len(ODD_LINES)


@pytest.mark.parametrize(("name", "least"), [("lint_findings", 0), ("lint_summary", 10), ("names_by_endings", 1), ("without_script_headers", 0)])
def test_lines_are_not_asked_pattern_by_pattern(spark, name, least):
    """The patterns of a query that are left to the engine: those of lines go through one function (ten of blocks before a Korean one stay)."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.count("RLIKE") <= least


def test_shapes_ask_the_rules_of_a_line_together(spark):
    plan = QUERIES["line_shapes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan


DEFECTS = {
    1: "one two three four\nand five\n\n그는 집으로 걸어 들어가서 오래오래 앉아 있었다\n\nten",
    2: "chorus\n\nchorus\n\nchorus\n\nA line that is long enough.\n\nA line that is long enough.\n \n\nA line that is long enough.\n\nx",
    3: "@MARY\nwhere are you going now\n\n@M ARY\n너는 지금 어디로 가고 있는 거니\n\n@TOM\nwhere are you going now\n\n@MARY\n너는 지금 어디로 가고 있는 거니",
    4: "\n\n@TOM\nwent home and slept\n\n\n다음 날 아침 일찍 그는 다시 나갔다\n\n한국어\n\nanother line of words here", 5: None, 6: "", None: "two\ntwo\n\na b\nc\n\na b\nc\n\na b\nc",
}


def test_defects_of_lines_and_blocks_are_counted_as_sql_does(agrees):
    assert agrees("lint_summary", DEFECTS)


@pytest.mark.parametrize("name", ["lint_summary", "script_summary"])
def test_defects_of_lines_and_blocks_share_a_shuffle(spark, name):
    """Texts are moved once, and bodies of blocks are there for patterns only where a Korean one follows."""
    rows = QUERIES[name](spark, "/root/testdata/sf0.001")
    rows.collect()
    done = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert done.count("ReusedExchange") == 1 and done.count("Exchange hashpartitioning") == 2  # one, and where it is used again
    optimized = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" in optimized and optimized.count("array_join") == optimized.count("array_join(filter(CASE WHEN next_korean")


def test_defects_of_scripts_are_counted_as_sql_does(agrees):
    assert agrees("script_summary", DEFECTS)


@pytest.mark.parametrize("name", ["lint_summary", "script_summary"])
def test_texts_do_not_come_along_where_headers_are_counted(spark, name):
    """What is ordered by header has no text of a line, its neighbours or its block; blocks are ordered twice, and a body is put together once."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n")
    at = [k for k, line in enumerate(plan) if "Sort [work#" in line and ", sig#" in line]
    assert len(at) == 1 and not any(f" {c}#" in plan[at[0] + 1].split(" AS _w0#")[0] for c in ("t", "prev", "head", "marks"))
    assert sum("Sort [work#" in line and ("island#" in line or "block_no#" in line) for line in plan) == 2
    assert QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("array_join") == 2  # of a block and of the next


def test_endings_are_looked_for_only_where_a_line_may_be_told(spark):
    ends = ["", "다", "간다.", "간다. \x85", "간다\x85\x85", "간다. ", "갑니다!", "다 아", "한다" + "." * 60, "." * 60, "한다" + " \r" * 3, "한다　~", "한다\n", "가요", None]
    rows = spark.createDataFrame([(t,) for t in ends], "t string")
    plain = T.sub(F.col("t"), korean.CLOSING)
    got = rows.select("t", korean.is_told(F.col("t")).alias("got"), (T.has(plain, korean.TOLD) & ~T.has(plain, korean.POLITE)).alias("want")).collect()
    assert [r.t for r in got if r.got != r.want] == [] and {r.want for r in got} == {True, False, None}
    plan = QUERIES["korean_script"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(CASE WHEN ((rtrim(" in plan and plan.count("trim(text#") <= 1  # a line is trimmed once, not for each pattern


def test_a_text_without_an_id_is_mended_too_and_lines_are_dealt_by_work(spark):
    rows = spark.createDataFrame([(w, n, t) for w, text in DEFECTS.items() if text is not None for n, t in enumerate(text.split("\n"))], "work long, line_no int, text string")
    got = {r.work: r.text for r in clean.autofix(rows).collect()}
    assert got[None] == "two\n\na b c" and set(got) == {1, 2, 3, 4, None}
    plan = clean.autofix(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "Join" not in plan
