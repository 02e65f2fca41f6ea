"""Batches asked for as one text and divided again; corrections within two edits."""

import random

from pyspark.sql import functions as F

from linewise.operators import incremental, joins

SCENES = "work string, scene_no int, scene string, batch int"


def test_batches_are_divided_and_bad_ones_asked_one_by_one(spark, tmp_path):
    log = str(tmp_path / "asked")

    def korean(text):
        """A provider's honest answer: headings, cues and lines, one for one."""
        return "\n".join("# 가" if x.startswith("#") else "@나" if x.startswith("@") else "- 안녕하세요" if x.startswith("- ") else "말" if x.strip() else x for x in text.split("\n"))

    def provider(texts):
        out = []
        for t in texts:
            with open(log, "a") as f:
                f.write(repr(t) + "\n")
            n = open(log).read().count(repr(t) + "\n")
            if "MERGED" in t and t.count("#") > 1:
                out.append(korean(t).replace("# 가", "가", 1))  # one heading too few
            elif "TORN" in t and t.count("#") > 1:
                out.append("# 가\n\n# 가\n@나\n@나\n@나")  # the parts have another structure
            elif "LEAKY" in t:
                out.append(("번역 대상이 없습니다\n" if n < 3 else "") + korean(t))
            elif "ALWAYS" in t:
                out.append("번역 대상이 없습니다")
            elif "REFUSE" in t:
                out.append("please paste the script")
            elif "WRONG" in t:
                out.append("# 가\n@나\n@나\n@나\n- 말")
            elif "NONE" in t:
                out.append(None)
            elif "SHORT" in t:
                out.append(korean(t) if n > 1 else "# 가")
            else:
                out.append("```\n번역:\n\n" + korean(t) + "\n```")
        return out

    scene = lambda name: f"# {name}\n@X\n- hello there\nwind"
    names = [("A", 0), ("B", 0), ("MERGED", 1), ("C", 1), ("TORN", 2), ("D", 2), ("E", 3), ("LEAKY", 4), ("ALWAYS", 5), ("REFUSE", 6), ("WRONG", 7), ("NONE", 8), ("SHORT", 9)]
    rows = [("w", i, scene(n), b) for i, (n, b) in enumerate(names)] + [("w", 99, "# OMITTED", 10)]
    got = {x.scene_no: x for x in incremental.translated_in_batches(spark.createDataFrame(rows, SCENES), provider).collect()}
    by_name = {n: got[i] for i, (n, _) in enumerate(names)}
    assert len(got) == len(rows) and {n for n, x in by_name.items() if x.batched} == {"A", "B"}
    assert {n: (x.status, x.error) for n, x in by_name.items() if x.status != "done"} == {"ALWAYS": ("error_translate", "META_LEAK"), "WRONG": ("error_translate", "STRUCTURE"), "NONE": ("error_translate", "NO_ANSWER")}
    assert all(by_name[n].result == korean(scene(n)) for n in ("A", "B", "MERGED", "C", "TORN", "D", "E", "LEAKY", "SHORT"))
    assert by_name["REFUSE"].result == scene("REFUSE") and got[99].result == "# OMITTED" and "OMITTED" not in open(log).read()
    times = open(log).read()
    assert times.count(repr(scene("E"))) == 1 and times.count(repr(scene("LEAKY"))) == 3 and times.count(repr(scene("ALWAYS"))) == 3 and times.count(repr(scene("SHORT"))) == 2


def test_words_within_two_edits_are_all_found(spark):
    r = random.Random(4)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(120)})
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    all_pairs = rows.crossJoin(rows.select(F.col("word").alias("known"))).withColumn("distance", F.levenshtein("word", "known"))
    for d in (1, 2):
        got = {tuple(x) for x in joins.near_words(rows, rows.select(F.col("word").alias("known")), d).collect()}
        assert got == {tuple(x) for x in all_pairs.filter(F.col("distance") <= d).collect()}


def test_corrections_two_edits_away_and_by_first_appearance(spark):
    tokens = [("w", "bright")] * 20 + [("w", "brghtt"), ("w", "shade"), ("w", "qwrtpsdfg")]
    rows = spark.createDataFrame(tokens, "work string, word string")
    assert joins.vocabulary_corrections(rows).count() == 0
    assert [(x.word, x.correction) for x in joins.vocabulary_corrections(rows, distance=2).collect()] == [("brghtt", "bright")]
    at = spark.createDataFrame([("w", i, x) for i, x in enumerate(["kxld"] + ["kold", "kild"] * 10)], "work string, line_no int, word string").withColumn("word", F.when(F.col("word") == "kxld", "kld").otherwise(F.col("word")))
    assert [x.correction for x in joins.vocabulary_corrections(at, first="line_no").collect()] == ["kold"]
    cues = spark.createDataFrame([("w", i, x) for i, x in enumerate(["FREDD1E"] + ["FREDDYE"] * 3 + ["FREDDIE"] * 9 + ["FRED"] * 9)], "work string, line_no int, name string")
    assert {(x.name, x.correction) for x in joins.cue_corrections(cues).collect()} == {("FREDD1E", "FREDDYE"), ("FREDDYE", "FREDDIE")}
