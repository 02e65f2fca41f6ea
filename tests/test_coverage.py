"""Lines looked up by suffixes against every cut; finished translations by hand; the last rows of hot keys."""

import random

from pyspark.sql import functions as F

from linewise.operators import coverage, incremental, joins, selection


def test_suffixes_are_in_order():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("abc가😀") for _ in range(r.randrange(1, 40)))
        assert coverage.suffixes(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert coverage.suffixes("ab" * 500).tolist() == sorted(range(1000), key=lambda i: ("ab" * 500)[i:])


def test_lines_are_found_as_by_trying_every_cut():
    r, seen = random.Random(2), set()
    for _ in range(600):
        text = "".join(r.choice("ab") for _ in range(r.randrange(0, 30)))
        line = "".join(r.choice("ab") for _ in range(r.randrange(0, 14)))
        found = coverage.Text(text)
        assert found.beginning(line) == max(k for k in range(len(line) + 1) if line[:k] in text)
        halves = any(line[:k] in text and line[k:] in text for k in range(3, len(line) - 2))
        assert found.holds(line) == (line in text) and found.holds_halves(line, 3) == halves
        seen.add((line in text, halves))
    assert len(seen) == 4


def test_categories_by_hand(spark):
    source = ["Some Title Page", "FADE IN: x", "INT. HOUSE - DAY", "A RUNNING HEAD", "he walks in slowly", "A RUNNING HEAD", "12 EXT. ROAD 12", "left side here right side there", "never seen again", "A RUNNING HEAD", "105.", "short", "xiv.", "- 12 -"]
    lines = spark.createDataFrame([("w", i, x) for i, x in enumerate(source)] + [("n", 0, "no text at all")], "work string, line_no int, text string")
    texts = spark.createDataFrame([("w", "# INT. HOUSE - DAY\nHe walks in SLOWLY.\nEXT. ROAD\nright side there / left side here")], "work string, text string")
    judged = coverage.coverage(lines, texts)
    assert [(x.work, x.line_no, x.category) for x in judged.orderBy("work", "line_no").collect()] == [
        ("n", 0, "body"), ("w", 0, "title"), ("w", 1, "title"), ("w", 2, "kept"), ("w", 3, "header"), ("w", 4, "kept"), ("w", 5, "header"), ("w", 6, "number"), ("w", 7, "kept"), ("w", 8, "body"), ("w", 9, "header"),
    ]
    report = {x.work: x for x in coverage.coverage_report(judged).collect()}
    assert tuple(report["w"])[1:6] == (10, 1, 2, 3, 1) and report["w"].percent == 90.0


def test_what_a_finished_translation_is(spark):
    cases = [
        (None, False), ("", False), ("# A\nhello", False), ("# 가\n@존\n- 안녕", True), ("# 가\n@HAL\n- 안녕", False), ("# 가\n@H.W. (V.O.)\n@AC/DC\n@fbi\n@X\n- 안녕", True),
        ("# 가\n- Hello there, my friend", False), ("# 가\n- Hello all", True), ("# 가\n(이탈리아어로)\n- Ciao a tutti voi, amici", True), ("# 가\n(이탈리아어로)\n@존\n- Ciao a tutti voi, amici", True),
        ("# 가\n(이탈리아어로)\n@존\n- 네\n- Ciao a tutti voi, amici", False), ("# 가\nwww.somewhere.com/page/one", True), ("# 가\n(SLAM CUT TO:)\nFADE OUT TO BLACK NOW", True), ("# 가\nTHE HOUSE BURNS DOWN", False),
        ("# INT. HOUSE - DAY\n가", False), ("# 가\n번역 대상이 없습니다", False), ("# 가\nBonjour, 안녕", True),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").orderBy("i")
    assert [x[0] for x in rows.select(incremental.fully_translated(F.col("t"))).collect()] == [x for _, x in cases]


def test_reuse_may_ask_for_equal_structure(spark):
    scenes = spark.createDataFrame([("w", 0, "# A\n@X\n- hello there"), ("w", 1, "# OMITTED")], "work string, scene_no int, scene string")
    done = spark.createDataFrame([("w", 0, "# 가\n# 나\n- 안녕하세요")], "work string, scene_no int, translated string")
    reusable = lambda **o: [x.reusable for x in incremental.plan_work(scenes, done, **o).orderBy("scene_no").collect()]
    assert reusable() == [True, True] and reusable(same_structure=True) == [False, True]


def test_the_last_rows_of_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 100)).alias("key"), (F.col("id") % 50).alias("at"), "id")
    got = selection.latest_n(rows, 5, ["key"], F.desc("at"), parts=4)
    want = {}
    for x in rows.collect():
        want.setdefault(x.key, []).append((-x["at"], x.id))
    best = {k: [i for _, i in sorted(own)[:5]] for k, own in want.items()}
    found = {}
    for x in got.orderBy("key", "rank").collect():
        found.setdefault(x.key, []).append(x.id)
    assert found == best and None in best
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_few_and_many_items_are_found_alike(spark, monkeypatch):
    r = random.Random(5)
    items = spark.createDataFrame([(i, "".join(r.choice("ab c") for _ in range(r.randrange(0, 9)))) for i in range(60)] + [(99, None)], "item long, text string")
    texts = spark.createDataFrame([(i, "".join(r.choice("ab c,") for _ in range(r.randrange(0, 40)))) for i in range(80)] + [(99, None), (99, "abc")], "doc long, text string")
    found = lambda: sorted(tuple(x) for x in joins.texts_containing(items, texts, "item", "doc").collect())
    scanned = found()
    monkeypatch.setattr(joins, "SCANNED", -1)
    assert scanned == found() and len(scanned) > 500
