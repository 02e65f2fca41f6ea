"""Tables that meet by key in one stream: patterns and lines, texts and lines."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from linewise.operators import coverage, names, together

LINES = "work string, line_no int, text string"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_meet_lines_without_a_group_for_each_work(spark, monkeypatch):
    monkeypatch.setattr(names, "PART", 3)  # long works are several parts
    r = random.Random(6)
    rows = [(w, i, "".join(r.choice("abc ") for _ in range(8))) for w in ["v", "w", "x", None] for i in range(10)] + [("x", 10, None)]
    patterns = [(w, "".join(r.choice("abc") for _ in range(2))) for w in ["v", "x", "y", None] for _ in range(4)]
    got = names.with_patterns(spark.createDataFrame(rows, LINES), spark.createDataFrame(patterns, "work string, pattern string"), lambda text, n, found: [(p,) for p in found.within(text)], "found string")
    want = {(w, i, p) for w, i, text in rows for of, p in patterns if w is not None and of == w and p in (text or "")}
    assert {tuple(x) for x in got.collect()} == want and len(want) > 10
    assert "CoGroup" not in plan_of(got)


def test_each_work_loses_its_own_stamps(spark):
    stamp = "© 20{} Fine Books - A GREAT TITLE"
    works = [chr(97 + i) for i in range(20)]
    lines = [(w, i, x) for k, w in enumerate(works) for i, x in enumerate([stamp.format(10 + k), "one", stamp.format(10 + k), f"two {stamp.format(10 + k)} so", f"of another {stamp.format(11 + k)} so"])]
    got = names.without_watermarks(spark.createDataFrame(lines, LINES))
    texts = {}
    for x in got.orderBy("work", "line_no").collect():
        texts.setdefault(x.work, []).append(x.text)
    assert texts == {w: ["", "one", "", "two so", f"of another {stamp.format(11 + k)} so"] for k, w in enumerate(works)}
    assert "CoGroup" not in plan_of(got)


def test_a_text_that_few_lines_ask_for_is_not_ordered(spark):
    text = coverage.Text("the quick brown fox jumps over the lazy dog" * 3)
    assert text.holds("quick brown") and text.holds_halves("the quick lazy dog") and not text.holds_halves("no such thing here")
    assert "order" not in text.__dict__ and "turned" in text.__dict__
    lines = spark.createDataFrame([("w", 0, "quick brown fox"), ("w", 1, "never seen again"), ("n", 0, "no text at all")], LINES)
    texts = spark.createDataFrame([("w", "The quick brown fox."), ("o", "another")], "work string, text string")
    judged = coverage.coverage(lines, texts)
    assert {(x.work, x.line_no): x.category for x in judged.collect()} == {("w", 0): "kept", ("w", 1): "body", ("n", 0): "body"}
    assert "CoGroup" not in plan_of(judged)


def test_scans_and_suffixes_find_the_same(monkeypatch):
    r = random.Random(7)
    cases = [("".join(r.choice("ab") for _ in range(r.randrange(0, 30))), "".join(r.choice("ab") for _ in range(r.randrange(0, 14)))) for _ in range(400)]
    asked = lambda: [(t.beginning(x), t.holds(x), t.holds_halves(x, 3)) for t, x in ((coverage.Text(t), x) for t, x in cases)]
    scanned = asked()
    monkeypatch.setattr(coverage, "SCANS", 0)
    assert scanned == asked()


def test_tables_that_are_already_dealt_by_the_key_meet(spark):
    rows = spark.range(20_000).select(F.col("id") % 500, F.col("id")).toDF("work", "n").groupBy("work").agg(F.max("n").alias("n"))
    lines = spark.range(20_000).select((F.col("id") % 500).alias("work"), F.col("id").alias("line")).withColumn("times", F.count(F.lit(1)).over(W.partitionBy("work")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = together.met(rows, lines, ("work",), lambda own: [n for _, n in own], lambda own, row: [(row[0], row[1], own)], "work long, line long, own array<long>").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 20_000 and all(x.own == [19_500 + x.work] for x in got)
