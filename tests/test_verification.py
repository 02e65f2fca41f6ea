"""Verification of sources, scenes and speakers by hand."""

from linewise.operators import joins, quality
from linewise.operators import lines as L


def rows_of(spark, **texts):
    return L.to_lines(spark.createDataFrame(list(texts.items()), "id string, text string"), "id", "text")


def test_a_source_is_tested_six_ways(spark):
    good = "\n".join(f"# INT. ROOM {i} - DAY\n@TOMMY\n- Hello there, all of you\n@MARY\n- And so on we go" for i in range(6))
    bad = "# 1NT. ROOM\n# INT. HALL\n# EXT. X\n# EXI. Y\n# FXT. Z\n# INI. W\n" + "@TOMMY\n- yes\n" * 5 + "@T0MMY\n@COP 1\n@COP 2\nbrtx klmn xq1z wrtp\nShhh hmmm zzzz brrr\n- " + "x" * 601
    issues = quality.source_issues(rows_of(spark, good=good, bad=bad, none="x"))
    got = {}
    for x in issues.collect():
        got.setdefault(x.work, {})[x.code] = (x.level, round(x.value, 3))
    assert set(got) == {"bad", "none"} and got["none"] == {"few_scenes": ("bad", 0.0), "few_cues": ("bad", 0.0)}
    assert got["bad"] == {"empty_cues": ("bad", 0.25), "junk": ("warn", 1.0), "heading": ("bad", 4.0), "variants": ("warn", 1.0), "long_dialogue": ("warn", 1.0), "few_cues": ("bad", 8.0)}
    works = spark.createDataFrame([("good",), ("bad",)], "work string")
    assert {x.work: x.fit for x in quality.fitness(issues, works).collect()} == {"good": True, "bad": False}


def test_missed_headings_are_flagged(spark):
    rows = {x.work: x for x in quality.scene_flags(rows_of(spark, a="# A\nTHE OLD HOUSE\n@NAME\nA LONG ROAD\n- NO\n(NO)\n# B\nSO IT GOES\nso it goes", b="# A\n" + "x" * 7000 + "\n# B\ny", c="no scene", d="# A\n" + "x" * 20001 + "\n# B")).collect()}
    assert (rows["a"].candidates, rows["a"].flags) == (3, ["missed headings"]) and rows["b"].flags == ["long mean"] and rows["c"].flags == ["no scenes"] and rows["d"].flags == ["long mean", "long scene"]


def test_numbers_are_anchors_only_where_all_agree(spark):
    a = rows_of(spark, w="# 10 A\nx\n# empty\n# 11 B\nx\n# C\nx\n# 12 D\nx", v="# 10 A\nx\n# 11 B\nx")
    b = rows_of(spark, w="# 10 가\nx\n# 새\n# 11 나\nx\n# 다\nx\n# 12 라\nx", v="# 10 가\nx\n# 12 나\nx")
    anchors = quality.number_anchors(a, b)
    assert sorted(tuple(x) for x in anchors.collect()) == [("w", 0, 0, 0), ("w", 1, 1, 2), ("w", 2, 3, 4)]
    assert [(x.work, x.nth, x.offset) for x in quality.offset_drift(anchors).collect()] == [("w", 1, 1)]


def test_speakers_of_scenes_with_as_many_cues(spark):
    en = "# A\n@TOM\n- hi\n@ANN (V.O.)\n- yo\n# B\n@TOM\n- x\n@ANN\n- y\nmore\n# C\n@TOM\n- x\n@ANN\n- y\n# D\n@TOM\n# E\nx"
    ko = "# 가\n@톰\n- 안\n@앤\n- 녕\n# 나\n@톰\n- 가\n@앤\n- 나\n# 다\n@앤\n- 가\n@앤\n- 나\n# 라\n@톰\n@톰\n# 마\nx"
    a, b = rows_of(spark, w=en), rows_of(spark, w=ko)
    assert sorted((x.scene_no, x.nth, x.a, x.b) for x in joins.cues_by_count(a, b).collect()) == [(0, 1, "TOM", "톰"), (0, 2, "ANN", "앤"), (1, 1, "TOM", "톰"), (1, 2, "ANN", "앤"), (2, 1, "TOM", "앤"), (2, 2, "ANN", "앤")]
    assert {x.scene_no: x.agree for x in joins.speakers_agree(a, b).collect()} == {0: True, 1: True, 2: False, 3: False, 4: True}


def test_fake_cues_are_narration(spark):
    rows = rows_of(spark, w="@TOMMY\n- hello\n\n@He opens the door, slowly and with care.\nso it goes\n@ CUT TO BLACK.\n@톰\n안녕")
    assert [(x.type, x.text) for x in L.typed_blocks(L.without_fake_cues(rows)).orderBy("block_no").collect()] == [
        ("character", "@TOMMY"), ("dialogue", "- hello"), ("action", "He opens the door, slowly and with care. so it goes CUT TO BLACK."), ("character", "@톰"), ("dialogue", "안녕"),
    ]
