"""Readers, sinks, the log as a stream, and operators that no query uses, on small files and rows."""

import json

from pyspark.sql import functions as F

from linewise.functions import text as T
from linewise.operators import align, clean, incremental, joins, quality, selection, windows
from linewise.operators import lines as L
from linewise.sources import readers, writers
from linewise.streaming import logs


def lines(spark, text, work="w"):
    return L.to_lines(spark.createDataFrame([(work, text)], "work string, text string"), "work", "text")


def test_scripts_by_the_kind_of_their_files(spark, tmp_path):
    for work, name, text in (("a", "x.rtf", r"{\rtf1\b Hello}"), ("b", "y.fdx", "<p>a</p>  <b>c</b>"), ("c", "z.fountain", "  INT. A\n")):
        (tmp_path / work).mkdir()
        (tmp_path / work / name).write_text(text)
    got = {r.work: r.text for r in readers.scripts(spark, str(tmp_path / "*/*")).collect()}
    assert got == {"a": "Hello", "b": "a\nc", "c": "  INT. A\n"}
    assert [r.x for r in readers.indented_lines(lines(spark, "a\n   b")).orderBy("line_no").collect()] == [0.0, 3.0]


def test_jobs_and_logs(spark, tmp_path):
    job = {"id": "j", "title": "t", "status": "running", "scenes": [{"id": 0, "status": "formatting", "tokens": {"format_in": 10, "format_out": 2, "translate_in": 5, "translate_out": 1}}, {"id": 1, "status": "translating"}, {"id": 2, "status": "done"}]}
    (tmp_path / "job.json").write_text(json.dumps(job, indent=1))
    jobs = readers.jobs(spark, str(tmp_path / "job.json"))
    assert [s.status for s in readers.recovered(jobs).first().scenes] == ["pending", "formatted", "done"]
    assert tuple(selection.token_cost(jobs).first()) == ("j", 15, 3, 15 * 3 / 1e6 + 3 * 15 / 1e6)
    rows = spark.createDataFrame([("2024-01-01 00:00:01", "info", "w", "start", "x")], "ts string, level string, work string, event string, detail string").withColumn("ts", F.to_timestamp("ts"))
    writers.append_log(rows, str(tmp_path / "log"))
    writers.append_log(rows, str(tmp_path / "log"))
    assert readers.process_log(spark, str(tmp_path / "log")).filter("event = 'start'").count() == 2


def test_read_words_make_lines(spark, tmp_path):
    head = "level page_num block_num par_num line_num word_num left top width height conf text".replace(" ", "\t")
    rows = ["5\t1\t1\t1\t1\t2\t50\t10\t9\t9\t90\tworld", "5\t1\t1\t1\t1\t1\t10\t10\t9\t9\t95\tHello", "5\t1\t1\t1\t1\t3\t90\t10\t9\t9\t20\tnoise", "5\t1\t2\t1\t1\t1\t10\t40\t9\t9\t80\tnext"]
    (tmp_path / "words.tsv").write_text("\n".join([head, *rows]))
    assert [(r.page, r.line_no, r.x, r.text) for r in readers.reading_words(spark, str(tmp_path / "words.tsv")).orderBy("line_no").collect()] == [(1, 0, 10.0, "Hello world"), (1, 1, 10.0, "next")]


def test_items_of_page_files(spark):
    files = spark.createDataFrame([("w", b"ab")], "work string, content binary")
    got = readers.positioned_items(files, lambda raw: [(1, i, chr(c), float(i), 5.0, 1.0) for i, c in enumerate(raw)])
    assert [(r.page, r.seq, r.str) for r in got.orderBy("seq").collect()] == [(1, 0, "a"), (1, 1, "b")]


def test_notes(spark):
    notes = spark.createDataFrame([("n", "top\n=== One (id: a) ===\nx\n=== Two (id: b) ===\ny\nz")], "work string, text string")
    assert [(r.name, r.id, r.body) for r in readers.review_sections(notes).orderBy("id").collect()] == [("One", "a", "x"), ("Two", "b", "y\nz")]
    items = spark.createDataFrame([(1, "a", "b", []), (2, "a", None, ["m"]), (3, "a", None, [])], "i int, target string, edited string, marks array<string>")
    assert [r.i for r in readers.direct_edits(items).collect()] == [1] and [r.i for r in readers.open_marks(items).collect()] == [2]
    found = spark.createDataFrame([("so: [1, 2] end",)], "t string").select(readers.json_array_in(F.col("t"), "array<int>").alias("a"))
    assert found.first().a == [1, 2]


def test_sinks(spark, tmp_path):
    texts = spark.createDataFrame([("a", "x\ny"), ("b", "z")], "work string, text string")
    writers.write_texts(texts, str(tmp_path / "out"))
    assert {(r.work, r.value) for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()} == {("a", "x\ny\n"), ("b", "z\n")}
    old = spark.createDataFrame([("a", "x\ny"), ("b", "q")], "work string, text string")
    assert [r.work for r in writers.changed(texts, old).collect()] == ["b"]
    blocks = spark.createDataFrame([("w", 1, "@X"), ("w", 0, "# A")], "work string, block_no int, text string")
    assert writers.rendered(blocks).first().text == "# A\n\n@X\n"
    edits = spark.createDataFrame([("w", "b1", "t")], "work string, block string, text string")
    assert json.loads(writers.overlay(edits).first().json) == {"id": "w", "edits": {"b1": "t"}}
    writers.append_new(spark.createDataFrame([("k", "r"), ("n", "r")], "line string, reason string"), spark.createDataFrame([("k",)], "line string"), str(tmp_path / "ok"), "line")
    assert [r.line for r in spark.read.json(str(tmp_path / "ok")).collect()] == ["n"]
    files = spark.createDataFrame([("/a/x.txt.ocrbak", 5), ("/a/x.txt", 9)], "path string, length long")
    assert tuple(writers.backup_usage(files).first()) == (1, 5)
    kept = writers.quarantine(texts, F.col("work") == "b", str(tmp_path / "q"))
    assert [r.work for r in kept.collect()] == ["a"] and spark.read.text(str(tmp_path / "q")).first().value == "b\tz"


def test_the_log_as_a_stream(spark, tmp_path):
    folder, schema = tmp_path / "in", "key string, at int, ts timestamp, event string"
    folder.mkdir()
    rows = lambda *r: "\n".join(json.dumps({"key": k, "at": a, "ts": f"2024-01-01T00:{m:02}:00", "event": e}) for k, a, m, e in r)
    (folder / "1.json").write_text(rows(("a", 1, 0, "x"), ("b", 1, 1, "x")))
    keep = lambda: logs.keep_latest(logs.tail(spark, str(folder), schema), str(tmp_path / "t"), str(tmp_path / "c"), "key", "at").start().awaitTermination()
    keep()
    (folder / "2.json").write_text(rows(("a", 2, 7, "y")))
    keep()
    latest = spark.read.parquet(str(tmp_path / "t/version=1"))
    assert {(r.key, r.at) for r in latest.collect()} == {("a", 2), ("b", 1)}
    counts = logs.events_per_window(spark.read.schema(schema).json(str(folder)))
    assert {(str(r.window_start)[11:16], r.event, r.n) for r in counts.collect()} == {("00:00", "x", 2), ("00:05", "y", 1)}


def test_texts_and_chunks(spark):
    values = lambda f, *texts: [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]
    assert values(T.is_refusal, "Please paste the script", "# A\npaste", "```\n# A\n```\nprovide the text") == [True, False, True]
    assert values(T.text_side, "# 내부. 집", "INT. HOUSE", "") == ["translated", "formatted", "formatted"]
    assert values(T.duplicate_key, "The Matrix (1999)", "matrix") == ["matrix", "matrix"] and values(T.as_cue, " JOHN: ") == ["@JOHN"]
    assert values(T.is_furniture, "(CONTINUED)", "12A.", "12 men") == [True, True, False]
    glued = clean.split_glued(lines(spark, "@X\n- 안녕\n영수가 문을 연다."))
    assert [r.text for r in glued.orderBy("line_no").collect()] == ["@X", "- 안녕", "", "영수가 문을 연다."]
    chunks = L.edit_chunks(lines(spark, "# A\n" + "x\n" * 34 + "# B\ny\nz"))
    assert [(r.first_line, r.last_line) for r in chunks.orderBy("chunk_no").collect()] == [(0, 24), (25, 34), (35, 37)]
    headers = lines(spark, "\n".join(f"The Movie {i}\na{i}b\nc{i}d\ne{i}f\nx" for i in range(5))).withColumn("page", F.floor(F.col("line_no") / 5))
    assert "the movie" in {r.key for r in clean.edge_headers(headers).collect()} and not [r for r in clean.strip_edge_headers(headers).collect() if "Movie" in r.text]
    gate = quality.result_gate(lines(spark, "\n".join(["# A"] * 5 + [f"english text {i}" for i in range(25)])))
    assert {(r.issue, r.value) for r in gate.collect()} == {("untranslated", 25)}
    issues = quality.issue_counts(spark.createDataFrame([("w", "[크레딧: a]\nINT. X\n[자막: b]")], "work string, text string")).first()
    assert tuple(issues) == ("w", 1, 1, 1)


def test_joins_without_a_query(spark):
    needles = lines(spark, "Hello, world out there\nnot here at all")
    texts = spark.createDataFrame([("w", "HELLO world!! x out there")], "work string, text string")
    assert [r.covered for r in joins.contained_lines(needles, texts).orderBy("line_no").collect()] == [True, False]
    pairs = spark.createDataFrame([("l1ne", "line"), ("lane", "line"), ("li", "line")], "a string, b string")
    assert [r.a for r in joins.single_substitutions(pairs, "a", "b", [("1", "i")]).collect()] == ["l1ne"]
    files = spark.createDataFrame([("/x/My_Film_formatted.txt",), ("/x/my film_translated.txt",), ("/x/My Film.pdf",)], "path string")
    row = joins.paired_files(files).first()
    assert row.base == "my film" and row.formatted and row.translated and row.pdf
    names = spark.createDataFrame([("w", "X", "엑스")], "work string, key string, value string")
    cues = spark.createDataFrame([("w", "X"), ("w", "Y")], "work string, cue string")
    assert [r.cue for r in joins.translated(cues, names, "cue").collect()] == ["엑스", "Y"]
    trapped = quality.trapped_names(lines(spark, "(ANN)\n- hi\n" * 5 + "(BOB)\n- hi"))
    other = spark.createDataFrame([("w", "앤", 6), ("w", "밥", 1)], "work string, name string, n long")
    assert [(r.name, r.other) for r in quality.paired_by_count(trapped, other).collect()] == [("ANN", "앤")]
    state = lambda leaks, pct, left: spark.createDataFrame([("w", leaks, pct, left)], "work string, leaks int, percent int, residue int")
    assert incremental.accepted(state(0, 90, 5), state(0, 90, 8)).first().accept and not incremental.accepted(state(0, 90, 5), state(1, 95, 5)).first().accept
    merged = spark.range(1).select(incremental.merged_names(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"))).alias("m")).first().m
    assert merged == {"a": "1", "b": "3"}
    told = spark.range(1).select(incremental.prompt(F.array(F.lit("songs"), F.lit("none")), {"songs": "Keep rhymes."}, "Base.").alias("p")).first().p
    assert told == "Base.\nKeep rhymes."
    planned = spark.createDataFrame([("w", i, i < 15) for i in range(25)] + [("v", 0, True)], "work string, scene_no int, reusable boolean")
    assert [(r.work, r.scenes, r.done) for r in incremental.wasteful(planned).collect()] == [("w", 25, 15)]
    versions = lambda rows: spark.createDataFrame([("w", i, c, n) for i, (c, n) in enumerate(rows)], "work string, scene_no int, cues int, lines int")
    assert [(r.a, r.b) for r in align.resumed(versions([(1, 5), (9, 9), (2, 6), (3, 7)]), versions([(1, 5), (2, 6), (3, 7)])).orderBy("a").collect()] == [(0, 0), (2, 1), (3, 2)]
    assert [r.line_no for r in windows.repeated_neighbours_in(spark.createDataFrame([("w", "a\na \n\na\na"), ("v", "a"), ("u", None)], "work string, text string"), "work", "text").orderBy("line_no").collect()] == [1, 4]
