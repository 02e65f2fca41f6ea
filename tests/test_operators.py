"""Operators on small literal rows: the cases that the given tables do not have."""

import random
import re
import math

from pyspark.sql import functions as F

from linewise.functions import text as T
from linewise.operators import align, clean, incremental, joins, quality, selection, windows
from linewise.operators import lines as L
from linewise.sources import readers


def lines(spark, text, work="w"):
    return L.to_lines(spark.createDataFrame([(work, text)], "work string, text string"), "work", "text")


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def texts_of(df, order="line_no"):
    return [r.text for r in df.orderBy(order).collect()]


def test_text_expressions(spark):
    assert value(spark, "　 x ", T.trim) == "x"
    assert value(spark, "Page 12 — TITLE (3)", T.signature) == "page title"
    assert value(spark, "  4. INT. ROOM - DAY 12", T.normal_heading).startswith("#")
    assert value(spark, "# INT. ROOM DAY1", T.normal_heading).endswith("DAY")
    assert value(spark, "ROOM 237", lambda c: T.normal_heading(c)).endswith("ROOM")  # a number at the end is a scene number
    assert value(spark, "DAYEXT. HDAYEXT. HDAYEXT. H1111", T.collapse_repeats) == "DAYEXT. H1"
    assert value(spark, "no run 1111", T.collapse_repeats) == "no run 1111"
    assert value(spark, "sky", T.looks_misread) is False and value(spark, "brzklt", T.looks_misread) is True
    assert value(spark, "JOHN (V.O.)", T.is_cue) is True and value(spark, "CUT TO:", T.is_cue) is False
    assert value(spark, "각", T.initial_consonant) == 0
    assert value(spark, "# OMITTED", T.nothing_to_translate) is True and value(spark, "# INT. ROOM", T.nothing_to_translate) is False
    assert value(spark, "Here is the translated script:", T.is_meta) is True
    assert sorted(value(spark, "ab ab", T.bigrams)) == ["ab", "ba"] and value(spark, "a", T.bigrams) == [] and value(spark, "", T.bigrams) == []
    year = lambda name, text: spark.createDataFrame([(name, text)], "n string, t string").select(T.year_of(F.col("n"), F.col("t"))).first()[0]
    assert year("film 1994", "x") == "1994" and year("film", "2001 copyright 1987") == "1987" and year("film", "none") is None


def test_repeats_of_any_length_are_folded(spark):
    r, run = random.Random(1), re.compile(r"(.{6,}?)\1{2,}")

    def plain(text):
        out, before = text, None
        while out != before:
            before, out = out, run.sub(r"\1", out)
        return re.sub(r"(\d)\1{2,}\s*$", r"\1", out) if out != text else out

    word = lambda n, letters="abcdefgh ": "".join(r.choice(letters) for _ in range(n))
    texts = ["", "x" * 500, "abcdef" * 100, word(900), word(130) * 3, word(130) * 2, word(40) + word(200) * 5 + word(77) + "1111", f"short\n{word(150) * 3} and {word(9) * 4}\nlast"]
    nested = word(7)
    for _ in range(6):
        nested = nested * 3 + word(1)
    texts += [nested, word(3000, "ab"), *(word(r.randrange(9)) + (word(r.randint(5, 9)) * r.randint(2, 4) + word(r.randint(0, 150))) * r.randint(2, 4) for _ in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.collapse_repeats(F.col("t")).alias("t")).collect()
    assert {x.i: x.t for x in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_blocks_scenes_and_chunks(spark):
    text = "# A\n\n@X\n- one\n- two\n\n\nout\n# B\n@Y\n(low)\n- three"
    rows = lines(spark, text)
    assert [(r.first_line, r.last_line) for r in L.to_blocks(rows).orderBy("block_no").collect()] == [(0, 0), (2, 4), (7, 11)]
    scenes = L.to_scenes(spark.createDataFrame([("w", text), ("e", None)], "work string, text string"), "work", "text")
    assert [r.scene[:3] for r in scenes.orderBy("scene_no").collect()] == ["# A", "# B"]
    assert [r.kinds for r in L.scene_kinds(rows).orderBy("scene_no").collect()] == ["SCDDA", "SCPD"]
    assert [(r.type, r.text) for r in L.typed_blocks(rows).orderBy("block_no").collect()] == [
        ("scene", "# A"), ("character", "@X"), ("dialogue", "- one - two"), ("action", "out"), ("scene", "# B"), ("character", "@Y"), ("paren", "(low)"), ("dialogue", "- three"),
    ]
    assert texts_of(L.to_text(rows), "work") == [text]
    long = lines(spark, "\n".join(str(i) for i in range(170))).withColumn("scene_no", F.lit(0))
    parts = L.split_long(long).groupBy("part_no", "continued").count().orderBy("part_no").collect()
    assert [(r.part_no, r.continued, r["count"]) for r in parts] == [(0, False, 80), (1, True, 80), (2, True, 10)]
    assert [r.logical_no for r in windows.logical_numbers(spark.createDataFrame([("w", 0, False), ("w", 1, True), ("w", 2, False)], "work string, part_no int, continued boolean")).orderBy("part_no").collect()] == [1, 1, 2]


def test_reflow_and_spacing(spark):
    assert texts_of(windows.reflow(lines(spark, "He went\nhome.\nThen\n- no\n@X\nend"))) == ["He went home.", "Then", "- no", "@X", "end"]
    assert windows.spaced_text(lines(spark, "\n\n# A\nx\n\n\n\ny  \n@Z\n- q\n\n")).first().text == "# A\nx\n\ny\n\n@Z\n- q"
    assert [r.line_no for r in windows.spacing_defects(lines(spark, "# A\n# B\n\n# C")).collect()] == [1]
    assert [r.line_no for r in windows.repeated_neighbours(lines(spark, "a\na\n\na\nb")).collect()] == [1]
    assert windows.repeated_blocks(lines(spark, "a b\nc\n\na b\nc")).count() == 0
    assert [r.first_line for r in windows.repeated_blocks(lines(spark, "a b\nc\n\na b\nc\n\na b\nc")).orderBy("block_no").collect()] == [3, 6]
    assert texts_of(windows.joined_headings(lines(spark, "# INT. RICHMOND -\n# - DAY (D6)\nx"))) == ["# INT. RICHMOND - DAY (D6)", "x"]


def test_cues(spark):
    rows = lines(spark, "@A\n\n@B\n(low)\n- hi\n@C")
    assert [r.line_no for r in windows.empty_cues(rows).orderBy("line_no").collect()] == [0, 5]
    assert [(r.cue, r.speech) for r in windows.first_speech(rows).collect()] == [("B", "- hi")]
    assert [r.line_no for r in windows.ghost_scenes(lines(spark, "# A\n\n# B\nx\n# C")).orderBy("line_no").collect()] == [0, 4]
    merged = joins.merged_cues(lines(spark, "@JAMES\n- the end. JAMES\n- I met JAMES today\n- my JAMES"))
    assert [(r.line_no, r.cue) for r in merged.collect()] == [(1, "JAMES")]
    long = joins.merged_cues(lines(spark, "@THE MAN WITH THE HAT\n@HAT\n- it ends. THE MAN WITH THE HAT\n- the end. HAT"))
    assert {(r.line_no, r.cue, r.speech) for r in long.collect()} == {(2, "THE MAN WITH THE HAT", "- it ends."), (3, "HAT", "- the end.")}
    assert [(r.line_no, r.next_line) for r in windows.close_repeated_cues(lines(spark, "@A\nx\n@A\n" + "y\n" * 9 + "@A")).collect()] == [(0, 2)]
    assert quality.dialogue_floor(lines(spark, "@A\n- x\n@A\n- y\n- z")).first().floor == 2


def test_positioned_text(spark):
    items = spark.createDataFrame([("w", 1, i, s, x, y, 5.0) for i, (s, x, y) in enumerate([("Hel", 0.0, 10.0), ("Hel", 0.2, 10.0), ("lo", 5.0, 11.0), ("next", 0.0, 30.0), (" ", 0.0, 50.0)])], "work string, page int, seq int, str string, x double, y double, width double")
    once = windows.without_overprint(items)
    assert [r.text for r in windows.y_lines(once).orderBy("line_no").collect()] == ["Hello", "next"]
    rows = spark.createDataFrame([("w", i, "t", x) for i, x in enumerate([50.0] * 40 + [120.0] * 30 + [124.0] * 5 + [300.0])], "work string, line_no int, text string, x double")
    assert [(r.low, r.high, r.peak, r.n) for r in windows.x_bands(rows).orderBy("low").collect()] == [(50, 50, 50, 40), (120, 125, 120, 35)]


def test_joins(spark):
    a = lines(spark, "# A\n@X\n- a\n# B\n@Y\n- b\n- c")
    b = lines(spark, "# 가\n@엑스\n- 가\n# 나\n@와이\n- 나")
    assert [(r.scenes_a, r.scenes_b, r.equal, r.percent) for r in joins.structure_match(a, b).collect()] == [(2, 2, 1, 50)]
    assert [(r.a, r.b) for r in joins.aligned_cues(a, b).collect()] == [("X", "엑스")]
    pairs = spark.createDataFrame([("w", i, k, v) for i, (k, v) in enumerate([("X", "1"), ("X", "1"), ("X", "1"), ("X", "2"), ("Y", "3"), ("Z", "4"), ("Z", "5")])], "work string, nth int, a string, b string")
    voted = joins.votes(pairs, F.col("a"), F.col("b"))
    assert {(r.key, r.value) for r in joins.dictionary(voted).collect()} == {("X", "1"), ("Y", "3")}
    assert {(r.key, r.value) for r in joins.dictionary(voted, "top").collect()} == {("X", "1"), ("Y", "3"), ("Z", "4")}
    counts = spark.createDataFrame([("FREDDIE", 9), ("FREDD1E", 1), ("COP 1", 9), ("COP 9", 1)], "word string, n long")
    assert [(r.word, r.partner) for r in joins.one_letter_variants(counts).collect()] == [("FREDD1E", "FREDDIE")]
    known = spark.createDataFrame([("w", x) for x in ["house"] * 9 + ["hxwsz"] + ["brght"] + ["bright"] * 8], "work string, word string")
    assert [(r.word, r.correction) for r in joins.vocabulary_corrections(known).collect()] == [("brght", "bright")]
    source, result = (spark.createDataFrame([("w", x) for x in words], "work string, word string") for words in (["a"] * 5 + ["b"], ["a"] * 3 + ["b", "c"]))
    assert [(r.word, r.lost) for r in joins.lost_words(source, result).collect()] == [("a", 2)]
    once = spark.createDataFrame([("a b a", "b", "x"), ("a b a", "a", "x"), ("a", "", "x")], "t string, o string, n string").select(joins.replace_once(F.col("t"), F.col("o"), F.col("n")).alias("r")).collect()
    assert [r.r for r in once] == ["a x a", "a b a", "a"]


def test_texts_containing_is_a_search(spark):
    items = ["a", "bc", "The quick, brown fox", "jumps over the lazy dog and runs far away from here", "", "ünï-code 12", "zzz"]
    docs = ["abc", "x the QUICKBROWN fox jumps over the lazy dog, and runs far away; from here!", None, "", "üNï CODE 1 2", "quick brown"]
    plain = lambda t: "".join(c for c in (t or "") if c.isalnum()).lower()
    want = {(i, d) for i, a in enumerate(items) for d, b in enumerate(docs) if plain(a) and plain(a) in plain(b)}
    table = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} long, text string")
    got = joins.texts_containing(table(items, "item_id"), table(docs, "doc_id"), "item_id", "doc_id")
    assert {(r.item, r.doc) for r in got.collect()} == want and len(want) > 5
    assert joins.texts_containing(table(items, "item_id").limit(0), table(docs, "doc_id"), "item_id", "doc_id").count() == 0


def test_alignment_and_packing(spark):
    sized = spark.createDataFrame([("w", i, n, True) for i, n in enumerate([20, 20, 20, 30, 10, 10])], "work string, scene_no int, lines int, heading boolean")
    assert [r.batch for r in align.pack(sized).orderBy("scene_no").collect()] == [0, 0, 0, 1, 2, 2]
    blocks = spark.createDataFrame([("w", i, "x" * n) for i, n in enumerate([30, 60, 20, 90])], "work string, block_no int, text string")
    assert [r.chunk for r in align.chunk_by_size(blocks, 100).orderBy("block_no").collect()] == [0, 0, 1, 2]
    assert [r.group for r in align.regroup(blocks, 2).orderBy("block_no").collect()] == [0, 0, 1, 1]
    assert [r.half for r in L.halves_by_size(blocks).orderBy("block_no").collect()] == [0, 0, 0, 1]
    typed = lambda kinds: spark.createDataFrame([("w", i, k) for i, k in enumerate(kinds)], "work string, block_no long, type string")
    assert [(r.a, r.b) for r in align.align_markers(typed("SCDA"), typed("SCA")).orderBy("a").collect()] == [(0, 0), (1, 1), (3, 2)]
    read = spark.createDataFrame([("w", "a b c d", "a x c")], "work string, reference string, reading string")
    assert [tuple(r) for r in align.reading_accuracy(read).collect()] == [("w", 4, 2, 1, 1, 0, 0.5)]


def test_findings_and_autofix(spark):
    text = "Here is the script:\n# A 12\n@X\n- 안녕\n- 안녕\nTITLE: One\nHe went\nhome."
    found = {(r.category, r.line_no) for r in clean.findings(lines(spark, text)).collect()}
    assert ("meta", 0) in found and ("dupe", 4) in found and ("spacing", 2) in found
    fixed = clean.autofix(lines(spark, text)).first().text
    assert "Here is" not in fixed and fixed.count("안녕") == 1 and "[자막: One]" in fixed and "He went home." in fixed
    row = clean.summary(lines(spark, text)).first()
    assert row.meta == 1 and row.dupe == 1 and row.lines == 8
    header = "BLUE REV. 1/2/99"
    often = clean.findings(lines(spark, "\n".join(f"{header} {i}\ntext {i}" for i in range(5))))
    assert {(r.work, r.category) for r in often.collect()} >= {("w", "boiler")}
    assert value(spark, "<p>a</p>  <b>c</b>", clean.strip_markup) == "a\nc"
    assert value(spark, r"{\rtf1\b Hello}", clean.strip_rtf) == "Hello"


def test_selection(spark):
    rows = spark.createDataFrame([("w", i) for i in range(10)], "work string, line_no int")
    assert sorted(r.line_no for r in selection.systematic_sample(rows, 4, "line_no").collect()) == sorted({math.floor(k * (10 / 4)) for k in range(4)})
    assert selection.systematic_sample(rows, 20, "line_no").count() == 10
    assert sorted(r.line_no for r in selection.budget_sample(rows, F.lit(4), 10, 3, "line_no").collect()) == [0, 3]
    old, new = (spark.createDataFrame(x, "k int, at int, v string") for x in ([(1, 1, "a"), (2, 5, "b")], [(1, 2, "c"), (2, 4, "d")]))
    assert {(r.k, r.v) for r in selection.upsert(old, new, "k", F.col("at")).collect()} == {(1, "c"), (2, "b")}
    assert value(spark, "Too many requests", T.error_class) == "rate" and value(spark, "socket hang up", T.error_class) == "network" and value(spark, "", T.error_class) == "unknown"
    assert value(spark, "author unknown", T.error_class) == "other" and value(spark, "not logged in", T.error_class) == "auth" and value(spark, "spawn ENOENT", T.error_class) == "proc"
    assert value(spark, "HTTP 529", T.is_transient) is True and value(spark, "syntax", T.is_transient) is False


def test_groups_are_aggregated_without_lists_of_their_rows(spark):
    from linewise.plans.queries import QUERIES

    for name in ("error_class_groups", "dedupe_by_normalized_key"):
        assert "collect_list" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_reuse(spark):
    scenes = spark.createDataFrame([("w", 0, "# A\n@X\n- hello there"), ("w", 1, "# B\nwind")], "work string, scene_no int, scene string")
    done = spark.createDataFrame([("w", 0, "# 가\n@엑스\n- 안녕하세요")], "work string, scene_no int, translated string")
    planned = incremental.plan_work(scenes, done)
    assert {r.scene_no: r.reusable for r in planned.collect()} == {0: True, 1: False}
    results = spark.createDataFrame([("w", 1, "please paste the script")], "work string, scene_no int, result string")
    assert {r.scene_no: r.final for r in incremental.with_fallback(planned, results).collect()}[1] == "# B\nwind"
    out = incremental.provided(scenes, "scene", lambda batch: [t.upper() for t in batch])
    assert {r.result for r in out.collect()} == {"# A\n@X\n- HELLO THERE", "# B\nWIND"}


def test_readers(spark, tmp_path):
    data = [("smi", "<SAMI><SYNC Start=1><P>안녕&nbsp;하세요<SYNC Start=2><P>그래".encode("cp949")), ("srt", "1\n00:00:01,000 --> 00:00:02,000\n<i>Hi</i>\n".encode("utf-16")), ("txt", "plain\n줄".encode())]
    files = spark.createDataFrame(data, "work string, content binary")
    got = readers.subtitle_lines(files)
    assert {(r.work, r.text) for r in got.collect()} == {("smi", "안녕 하세요"), ("smi", "그래"), ("srt", "Hi"), ("txt", "plain"), ("txt", "줄")}
    assert {r.text for r in readers.korean_entries(got).collect()} == {"안녕 하세요", "그래"}
    (tmp_path / "lines.tsv").write_text("1\t10\t20\ta\tb\n")
    assert [tuple(r) for r in readers.reading_lines(spark, str(tmp_path / "lines.tsv")).collect()] == [(1, 10.0, 20.0, "a\tb")]
    notes = spark.createDataFrame([("w", "head\n---\n[씬 3 · 대사]\n원문: hi\n번역: 안녕\n● [톤 · 오역] — 메모\n---\n[씬 4 · 지문]\n번역: 가\n수정됨: 나")], "work string, text string")
    items = readers.feedback(notes).orderBy("item_no").collect()
    assert [(r.scene, r.target, r.edited, len(r.marks)) for r in items] == [("3", "안녕", None, 1), ("4", "가", "나", 0)]
    assert items[0].marks[0].tags == ["톤", "오역"] and items[0].marks[0].memo == "메모"
