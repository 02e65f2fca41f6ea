"""Lines most like wanted texts, against all pairs; what the join moves."""

import random

from linewise.operators import joins, likeness

TEXTS = "work string, item int, text string"


def pairs_of(text):
    plain = "".join(text.split())
    return {plain[i : i + 2] for i in range(len(plain) - 1)}


def by_all_pairs(wanted, lines, least):
    best = {}
    for work, item, w in wanted:
        for other, n, t in lines:
            w, t = (w or "").strip(), (t or "").strip()
            if work is None or work != other or not t:
                continue
            a, b = pairs_of(w), pairs_of(t)
            s = 2.0 if w == t else len(a & b) / len(a | b) if a | b else 0.0
            if s >= least:
                best[work, item] = max(best.get((work, item), (0.0, 1)), (s, -n))
    return {k: (-n, min(1.0, s)) for k, (s, n) in best.items()}


def cases(seed):
    r = random.Random(seed)
    text = lambda: "".join(r.choice("ab 가😀") for _ in range(r.randrange(0, 14)))
    lines = [(w, i, text()) for w in "xyz" for i in range(60)] + [(None, 0, "abab"), ("x", 60, None)]
    near = lambda t: t[: r.randrange(len(t) + 1)] + r.choice(["", "a", " "]) + t[r.randrange(len(t) + 1) :]
    wanted = [(w, i, near(t or "")) for w, i, t in lines if i % 2] + [(w, i, text()) for w in "xyq" for i in range(100, 130)] + [(None, 1, "abab"), ("x", 200, None)]
    return wanted, lines


def found(spark, wanted, lines, least):
    got = joins.fuzzy_lines(spark.createDataFrame(wanted, TEXTS), spark.createDataFrame(lines, "work string, line_no int, text string"), least)
    return {(x.work, x.item): (x.line_no, x.similarity) for x in got.collect()}


def test_the_most_alike_line_is_found(spark):
    for seed, least in ((1, 0.7), (2, 0.5), (3, 1.0)):
        wanted, lines = cases(seed)
        want = by_all_pairs(wanted, lines, least)
        assert found(spark, wanted, lines, least) == want and len(want) > 20


def test_long_works_and_small_blocks(spark, monkeypatch):
    for name in ("PART", "ROWS", "PAIRS"):
        monkeypatch.setattr(likeness, name, 7)
    wanted, lines = cases(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert found(spark, wanted, lines, 0.7) == by_all_pairs(wanted, lines, 0.7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_pair_of_characters_is_a_row_of_its_own(spark):
    wanted, lines = cases(5)
    plan = joins.fuzzy_lines(spark.createDataFrame(wanted, TEXTS), spark.createDataFrame(lines, "work string, line_no int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("Generate") == 1
