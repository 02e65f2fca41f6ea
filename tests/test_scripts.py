"""Rules and operators over scripts on rows written by hand from what they must do."""

import pytest
from pyspark.sql import functions as F

from linewise.functions import shapes as S
from linewise.functions import text as T
from linewise.operators import korean, layout, repair, scenes
from linewise.operators import lines as L


def lines(spark, text, work="w"):
    return L.to_lines(spark.createDataFrame([(work, text)], "work string, text string"), "work", "text")


def values(spark, texts, *tests):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in rows.select("i", *[f(F.col("t")) for f in tests]).orderBy("i").collect()]


def texts_of(df, order="line_no"):
    return [r.text for r in df.orderBy(order).collect()]


def blocks(spark, rows):
    return spark.createDataFrame([("w", i, a, b) for i, (a, b) in enumerate(rows)], "work string, block_no int, type string, text string")


SHAPES = [
    # text, test, expected
    ("TOM", S.is_transition, False), ("ONE", S.is_transition, False), ("CUT TO:", S.is_transition, True), ("BACK TO:", S.is_transition, True), ("SMASH CUT TO BLACK:", S.is_transition, True),
    ("INT. HOUSE - DAY", S.opens_scene, True), ("f*  INT. HOUSE", S.opens_scene, True), ("FARMHOUSE - DAY", S.opens_scene, True), ("A TELEVISION SET", S.opens_scene, False), ("INT.", S.opens_scene, False),
    ("DARBY :", S.is_likely_heading, False), ("B10", S.is_likely_heading, False), ("OLD HOUSE", S.is_likely_heading, True), ("He sits.", S.is_likely_heading, False), ("Page 4", S.is_likely_heading, False),
    ("JOHN (V.O.)", S.is_page_cue, True), ("CLOSE ON JOHN", S.is_page_cue, False), ("END OF ACT ONE", S.is_page_cue, False), ("JOHN!", S.is_page_cue, False),
    ("@JOHN (V.O.)", S.is_marked_cue, True), ("@THE KITCHEN", S.is_marked_cue, False), ("@존이 본다", S.is_marked_cue, False), ("@DOCTOR ROOM", S.is_marked_cue, True), ("@존", S.is_marked_cue, True),
    ("ÉLOÏSE (OFF)", S.is_european_cue, True), ("Éloïse", S.is_european_cue, False), ("A", S.is_european_cue, False),
    ("OMITTED 105", S.is_page_heading, True), ("INT—CAR", S.is_page_heading, True), ("12A INT. CAR", S.is_page_heading, True), ("MILES' UNIVERSE: NIGHT", S.is_page_heading, True), ("INTO THE CAR", S.is_page_heading, False),
    ("NOTE: x", S.is_junk, True), ("@REVISED 7/27/87", S.is_junk, True), ("7/27/87", S.is_junk, True), ("  ", S.is_junk, True), ("[크레딧: X]", S.is_junk, False),
    ("He sits down.", S.is_english_narration, True), ("The DOG barks", S.is_english_narration, True), ("He loves me.", S.is_english_narration, False), ("Walk on.", S.is_english_narration, False),
    ("i", S.is_garbage, True), ("D-10", S.is_garbage, True), ("g v X", S.is_garbage, True), ("^ ~", S.is_garbage, True), ("Go on.", S.is_garbage, False), ("Me?", S.is_garbage, False), ("아 |", S.is_garbage, False),
    ("Shhh", S.looks_fake, False), ("brzk", S.looks_fake, True), ("l1ne", S.looks_fake, True), ("sky", S.looks_fake, True), ("good", S.looks_fake, False), ("an", S.looks_fake, False),
    ("번역 대상이 없습니다", T.is_leak, True), ("```", T.is_leak, True), ("<system>", T.is_leak, True), ("- 제가 번역해 드리겠습니다", T.is_leak, False), ("번역합니다", T.is_leak, True), ("원하시면 다시 번역", T.is_leak, True),
    ("COP", T.is_cue, True), ("A MAN'S VOICE", T.is_cue, False), ("THE HALLWAY", T.is_cue, False), ("OFFICER ROOM", T.is_cue, True),
]


def test_shapes(spark):
    rows = spark.createDataFrame([(t,) for t, _, _ in SHAPES], "t string")
    for text, test, want in SHAPES:
        pass
    got = rows.select("t", F.monotonically_increasing_id().alias("i"))
    tests = {f.__name__: f for _, f, _ in SHAPES}
    found = {r.t: r for r in got.select("t", *[f(F.col("t")).alias(name) for name, f in tests.items()]).collect()}
    wrong = [(t, f.__name__) for t, f, want in SHAPES if found[t][f.__name__] is not want]
    assert not wrong


def test_translations(spark):
    rows = spark.createDataFrame([("CUT TO:", None), ("Hi there", None), ("Hi", "Hi"), ("Go now", "Go now then"), ("Louis!", "Louis!"), ("BMW", "BMW X"), ("Hi", "안녕"), ("Sorry.", "Sorry...")], "a string, b string")
    assert [r[0] for r in rows.select(S.needs_translation(F.col("a"), F.col("b"))).collect()] == [False, True, True, True, True, False, False, True]
    hanja = spark.createDataFrame([("内부", "INT"), ("집(家)", "HOUSE"), ("家", "家")], "a string, b string")
    assert [r[0] for r in hanja.select(S.has_stray_hanja(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    names = [("ANDREW", "마크", False), ("MIA", "마크", False), ("MIA", "미아", True), ("GRACE", "그레이스", True), ("MR. KRAMER", "크레이머 씨", True), ("TOM", "톰이라는아주긴이름", False)]
    pairs = spark.createDataFrame([(a, b) for a, b, _ in names], "a string, b string")
    assert [r[0] for r in pairs.select(S.may_be_spelling_of(F.col("a"), F.col("b"))).collect()] == [x for *_, x in names]


@pytest.mark.parametrize(("f", "text", "want"), [
    (S.cue_from_speech, "- NARRATOR (V.O.)", "@NARRATOR (V.O.)"), (S.cue_from_speech, "- @JOE (CONT'D)", "@JOE (CONT'D)"), (S.cue_from_speech, "- yes (what)", "- yes (what)"),
    (S.clean_cue, "@TOMMY & BILLY", "@TOMMY & BILLY"), (S.clean_cue, "@3:00 AM", "@3:00 AM"), (S.clean_cue, "@- DAY", "@- DAY"), (S.clean_cue, "@^C JOHN", "@JOHN"), (S.clean_cue, "@* SPSN", "@* SPSN"),
    (S.korean_heading, "# INT./EXT. CAR", "# 내부/외부 CAR"), (S.korean_heading, "# INTERCUT A", "# 인터컷 A"), (S.korean_heading, "# 내부. 트럭/EXT. 거리", "# 내부. 트럭/외부. 거리"), (S.korean_heading, "INT. X", "INT. X"),
    (S.dotted_korean_heading, "# I/E. CAR", "# 내부./외부. CAR"), (S.dotted_korean_heading, "# EXT./INT. CAR", "# 외부./내부. CAR"), (S.hangul_places, "# 内部. 집", "# 내부. 집"),
    (lambda c: S.printed_once(c, 12), "HELLO WORLD THAT ISHELLO WORLD THAT IS MORE", "HELLO WORLD THAT IS MORE"), (lambda c: S.printed_once(c, 12), "nothing is printed twice here", "nothing is printed twice here"),
    (S.plain_marks, "TIME CUT TO꞉ “a”", 'TIME CUT TO: "a"'), (S.without_controls, "a\x00b\tc", "ab\tc"), (S.english_markers, "[크레딧: A]\nINT. B", "[CREDIT: A]\n# INT. B"), (S.display_heading, "6 INT. A 6", "INT. A"),
    (S.loose_key, "The  Martian 5.", "The Martian"), (S.without_lead_junk, "^* Go on", "Go on"), (S.without_lead_junk, "(beat) x", "(beat) x"), (layout.page_heading_text, "12A. INT. ROOM DAY1", "INT. ROOM DAY"),
])
def test_forms(spark, f, text, want):
    assert values(spark, [text], f)[0][0] == want


def test_reports(spark):
    one = spark.range(1)
    log = F.array(F.lit("번역 시작: 12 씬"), F.lit("3/12 (실패 1)"), F.lit("x"))
    assert tuple(one.select(S.progress(log)).first()[0]) == (3, 12, 1) and tuple(one.select(S.progress(F.array(F.lit("__SCENES__ 7")))).first()[0]) == (0, 7, 0)
    got = one.select(S.duration_text(F.lit(42000)), S.duration_text(F.lit(185400)), S.tokens_text(F.lit(999)), S.tokens_text(F.lit(1549)), S.ago_text(F.lit(30000)), S.ago_text(F.lit(7200000)), S.ago_text(F.lit(86400000 * 8))).first()
    assert tuple(got) == ("42s", "3m 5s", "999", "1.5k", "방금", "2시간 전", None)
    assert one.select(S.indent_of(F.lit(143.0), F.lit(108.0))).first()[0] == 5 and one.select(S.indent_of(F.lit(900.0), F.lit(0.0))).first()[0] == 40
    parts = one.select(S.speech_parts(F.lit("(작게) 안녕 (웃으며)")).alias("p"), S.voice_name(F.lit("은주의 목소리> 안녕")).alias("v"), S.replaced_words(F.lit("teh cat_x teh."), F.create_map(F.lit("teh"), F.lit("the"))).alias("r")).first()
    assert tuple(parts.p) == ("작게", "안녕", "웃으며") and parts.v == "은주" and parts.r == "the cat_x the."


RAW = "TITLE\nby X\n\nINT. HOUSE - DAY\nHe enters.\n\nJOHN\n    Hello there\n    friend.\nHe leaves\nthe room.\n\nEXT. ROAD - NIGHT\nMARY (V.O.)\nYes."


def test_raw_scripts(spark):
    texts = spark.createDataFrame([("w", RAW), ("t", "written by X\nBook"), ("n", "Page 3/9\nonly text")], "work string, text string")
    found = {(r.work, r.scene_no): r.raw for r in scenes.scenes_by_headings(texts).collect()}
    assert {k: v.split("\n")[0] for k, v in found.items()} == {("w", 0): "INT. HOUSE - DAY", ("w", 1): "EXT. ROAD - NIGHT", ("t", 0): "written by X", ("n", 0): ""}
    got = {r.work: r for r in scenes.rule_formatted(texts).collect()}
    assert got["w"].formatted == "TITLE by X\n\n# INT. HOUSE - DAY\nHe enters.\n\n@JOHN\nHello there friend.\n\nHe leaves the room.\n\n# EXT. ROAD - NIGHT\n@MARY (V.O.)\n\nYes."
    assert (got["w"].headings, got["w"].cues, got["w"].confidence) == (2, 2, 0.6) and got["n"].confidence == pytest.approx(0.1)
    starts = spark.createDataFrame([("w", 0), ("w", 3), ("w", 12)], "work string, line_no int")
    assert [len(r.raw.split("\n")) for r in scenes.scenes_at(lines(spark, RAW), starts).orderBy("scene_no").collect()] == [3, 9, 3]
    one = spark.range(1)
    keep = lambda a, b: scenes.takes_new_extraction(F.lit(a), F.lit(b))
    assert tuple(one.select(keep(20, 13), keep(20, 14), keep(19, 0)).first()) == (False, True, True)
    split = lambda a, b, c: scenes.takes_model_split(F.lit(a), F.lit(b), F.lit(c))
    assert tuple(one.select(split(5, 5, 6), split(5, 6, 0), split(5, 5, 7), split(5, 4, 0)).first()) == (True, False, False, True)
    assert [(r.type, r.text) for r in layout.indented_blocks(lines(spark, RAW)).orderBy("block_no").collect()][:2] == [("scene", "# INT. HOUSE - DAY"), ("action", "He enters.")]
    assert values(spark, ["INT. A\n 12. EXT. B\nx INT."], scenes.raw_headings) == [(2,)]


def test_indentation(spark):
    text = "INT. A\n" + "\n".join(f"Told {i}.\n" + " " * 30 + "JOHN\n" + " " * 10 + "Hello\n" + " " * 11 + "there.\n" + " " * 11 + "x" for i in range(21))
    got = [(r.type, r.text) for r in layout.indented_blocks(lines(spark, text)).orderBy("block_no").collect()]
    assert got[:5] == [("scene", "# INT. A"), ("action", "Told 0."), ("character", "@JOHN"), ("dialogue", "- Hello there. x"), ("action", "Told 1.")]


def positioned(spark):
    rows, y, page = [], 800, 1

    def add(x, text, down=14):
        nonlocal y
        y -= down
        rows.append(("w", page, len(rows), float(x), float(x) + 6 * len(text), float(y), text))

    add(108, "INT. HOUSE - DAY 12")
    for _ in range(8):
        add(108, "He walks through the long dark hall and", 28)
        add(108, "opens the door.")
        add(250, "JOHN", 28)
        add(200, "(low)")
        add(108, "Who is there at this hour of")  # a line set wrong: it follows a speaker
        add(180, "the night?")
    add(400, "CUT TO:", 28)
    add(108, "EXT. RICHMOND -", 28)
    add(108, "INT. - NIGHT")
    add(500, "7A")
    add(108, "CONTINUED: (2)")
    add(108, "OMITTED105")
    add(108, "Rain falls.", 28)
    add(250, "MARY", 28)
    page, y = 2, 800
    add(108, "Snow falls.")
    add(250, "MARY", 28)
    return spark.createDataFrame(rows, "work string, page int, line_no int, x double, x2 double, y double, text string")


def test_pages(spark):
    lines = positioned(spark)
    assert tuple(layout.bands(lines).first()) == ("w", 110, 170, 230, 550)
    got = [(r.type, r.text) for r in layout.page_blocks(lines).orderBy("block_no").collect()]
    assert got[:5] == [("scene", "# INT. HOUSE - DAY"), ("action", "He walks through the long dark hall and opens the door."), ("character", "@JOHN"), ("paren", "(low)"), ("dialogue", "- Who is there at this hour of the night?")]
    assert got[-4:] == [("transition", "(CUT TO:)"), ("scene", "# EXT. RICHMOND - INT. - NIGHT"), ("action", "Rain falls."), ("dialogue", "- Snow falls.")]  # a leftover speaker still speaks
    few = lines.filter("line_no < 3")
    assert layout.bands(few).first().dialogue == layout.bands(few).first().x_action + 50


def test_title_pages_and_numbered_headings(spark):
    rows = [("action", "Written by X"), ("action", "FADE IN: dark"), ("character", "@X"), ("transition", "(CUT TO:)"), ("scene", "# INT. A")] + [("action", f"line {i}") for i in range(95)]
    got = [r.text for r in layout.without_title_page(blocks(spark, rows)).orderBy("block_no").collect()]
    assert got[:3] == ["FADE IN: dark", "(CUT TO:)", "# INT. A"] and len(got) == 98
    assert layout.without_title_page(blocks(spark, rows[:20])).count() == 20  # the first scene comes late
    numbered = [("w", 1, i, 108.0, 300.0, 800.0 - 14 * i, t) for i, t in enumerate([f"{n}. THE OLD HOUSE He sits {n}." for n in range(1, 12)])]
    df = spark.createDataFrame(numbered, "work string, page int, line_no int, x double, x2 double, y double, text string")
    assert [(r.type, r.text) for r in layout.page_blocks(df).orderBy("block_no").collect()][:2] == [("scene", "# THE OLD HOUSE"), ("action", "He sits 1.")]


def test_page_furniture(spark):
    items = spark.createDataFrame([("w", 1, i, s, x, 700.0 - i, 10.0) for i, (s, x) in enumerate([("7A", 60.0), ("walks", 108.0), ("7A", 120.0), ("home", 300.0), ("7A", 400.0)])], "work string, page int, seq int, str string, x double, y double, width double")
    assert [(r.str, r.x) for r in layout.without_margin_numbers(items).orderBy("seq").collect()] == [("walks", 108.0), ("7A", 120.0), ("home", 300.0)]
    rows = [("w", p, 10 * p + i, 0.0, 0.0, 0.0, t) for p in range(1, 6) for i, t in enumerate([f"The Martian Script {p}.", "a", "b", "@ACE (V.O.)", "c", "d", "x CONFIDENTIAL COPY OF MINE" if p == 2 else "CONFIDENTIAL COPY OF MINE"])]
    df = spark.createDataFrame(rows, "work string, page int, line_no int, x double, x2 double, y double, text string")
    assert {(r.key, r.loose, r.n) for r in layout.page_headers(df).collect()} == {("The Martian Script", True, 5), ("CONFIDENTIAL COPY OF MINE", False, 4), ("CONFIDENTIAL COPY OF MINE", True, 4)}
    left = texts_of(layout.without_page_headers(df))
    assert left.count("@ACE (V.O.)") == 5 and left.count("x") == 1 and not [t for t in left if "Martian" in t or "CONFIDENTIAL" in t]
    ranked = spark.createDataFrame([("w", v) for v in [1, 2, 3, 4]] + [("e", None)], "work string, v int")
    assert {(r.work, r.q) for r in layout.nearest_rank(ranked, F.col("v"), 0.5, "q").collect()} == {("w", 3)}


def test_european_pages(spark):
    rows = [("w", 1, 700 - 10 * i, x, t) for i, (x, t) in enumerate([(50, "12 - Extérieur route"), (50, "très loin EXT NUIT"), (50, "Il marche."), (150, "ÉLOÏSE (OFF)"), (150, "Bonjour."), (300, "far")] * 3)]
    df = spark.createDataFrame(rows, "work string, page int, y int, x int, text string")
    assert [(r.type, r.text) for r in layout.european_lines(df).orderBy("line_no").collect()][:4] == [("scene", "# 12 - Extérieur route très loin EXT NUIT"), ("action", "Il marche."), ("character", "@ÉLOÏSE (OFF)"), ("dialogue", "- Bonjour.")]


def test_repairs(spark):
    got = repair.caption_blocks(lines(spark, "a\n[크레딧: X\nY]\nb\n[자막: z]\n[크레딧: q]")).orderBy("block_no").collect()
    assert [(r.type, r.text) for r in got] == [("plain", "a"), ("크레딧", "X\nY"), ("plain", "b"), ("자막", "z"), ("크레딧", "q")]
    doubles = "# INT. A\n\n# 내부. A\n@ARON\n@아론\nThe man walks into the big house and sits.\n\n남자가 큰 집으로 걸어 들어가 앉는다.\nBonjour mon ami, comment allez-vous\n남자가 큰 집으로 걸어 들어가 앉는다."
    assert texts_of(repair.without_doubles(lines(spark, doubles))) == ["# 내부. A", "@아론", "남자가 큰 집으로 걸어 들어가 앉는다.", "Bonjour mon ami, comment allez-vous", "남자가 큰 집으로 걸어 들어가 앉는다."]
    assert texts_of(repair.trapped_cues(lines(spark, "(TOM)\n- hi\n(to TOM)\n- x\n(CUT TO BLACK)\n- y\n(TOM)\nz"))) == ["@TOM", "- hi", "(to TOM)", "- x", "(CUT TO BLACK)", "- y", "(TOM)", "z"]
    assert texts_of(repair.without_restarts(lines(spark, "# A\nx\nHere is the translation\ny\n# B\nz"))) == ["y", "# B", "z"]
    assert texts_of(repair.without_echo(lines(spark, "```text\n번역:\n\n# A\n번역:\nx\n```\n"))) == ["# A", "번역:", "x"]
    assert texts_of(repair.without_empty_headings(lines(spark, "#\n# 생략\n# A\n그대로 출력합니다\nx"))) == ["# A", "x"]
    assert texts_of(repair.cleaned_reading(lines(spark, "@^C JOHN\ni\n^* Going on\nNo.\n\n|~ \nDone"))) == ["@JOHN", "Going on", "No.", "", "Done"]
    names = spark.createDataFrame([("w", "DOOR")], "work string, name string")
    assert texts_of(repair.demoted_cues(lines(spark, "@DOOR (V.O.)\n  @ DOOR\n@DOORS"), names)) == ["DOOR (V.O.)", "  DOOR", "@DOORS"]
    urls = "\n".join(["a https://site.example/some/very/long/path/to/a/script/page1 b"] * 5 + ["see https://other.example/x"])
    assert texts_of(repair.url_marks_removed(lines(spark, urls))) == ["a b"] * 5 + ["see https://other.example/x"]
    stamp = "© 2013 Fine Books - A GREAT TITLE"
    got = repair.stamps(lines(spark, f"before {stamp} x\n{stamp}\n- so {stamp} on\n{stamp}\nNo Stamp - HERE NOW"))
    assert {(r.stamp, r.n) for r in got.collect()} == {(stamp, 3)}
    patches = spark.createDataFrame([("w", 1, 2, "X\nY\nZ"), ("w", 4, 4, "Q")], "work string, first_line int, last_line int, text string")
    assert texts_of(repair.patched(lines(spark, "a\nb\nc\nd\ne\nf"), patches)) == ["a", "X", "Y", "Z", "d", "Q", "f"]
    works = spark.createDataFrame([("Alien",), ("ALIEN",), ("heat",)], "work string")
    notes = spark.createDataFrame([("ALIEN",), ("Heat",), ("none",)], "id string")
    assert {(r.id, r.work) for r in repair.found_works(notes, works).collect()} == {("ALIEN", "ALIEN"), ("Heat", "heat")}
    cut = repair.trailing_actions(blocks(spark, [("dialogue", "la la\nHe sits.\nla"), ("dialogue", "He sits.\nla"), ("action", "x\nHe sits.")]))
    assert [(r.block_no, r.part, r.type, r.text) for r in cut.orderBy("block_no", "part").collect()] == [(0, 0, "dialogue", "la la"), (0, 1, "action", "He sits.\nla"), (1, 0, "dialogue", "He sits.\nla"), (2, 0, "action", "x\nHe sits.")]
    assert [r[0] for r in spark.createDataFrame([("a", True), ("b", False)], "p string, k boolean").select(repair.first_versions(F.col("p"), F.col("k"))).collect()] == [None, "b.before"]


def test_script_headers(spark):
    text = "10/6/03 MM revs. (pink) 1A.\nHe sits. The Martian Shooting Script 5.\n\nBlue Rev. (mm/dd/yy) 66.\n\n# OMITTED\n- so OMITTED 라고 말했다\nPINK SHOOTING SCRIPT (JUNE 17, 2024) 60DA.\nTan Rev. (Jan 31 '18) - 1518 3bA.\nMOVED TO SC 230A\nHe left, .\nplain"
    assert texts_of(repair.without_script_headers(lines(spark, text))) == ["He sits.", "", "- so 라고 말했다", "He left, .", "plain"]


def test_realignment(spark):
    source = blocks(spark, [("action", "top"), ("scene", "# A"), ("action", "a1"), ("action", "a2"), ("character", "@X"), ("dialogue", "d"), ("scene", "# B")])
    result = blocks(spark, [("action", "위"), ("scene", "# 가"), ("action", "1"), ("action", "2"), ("action", "3"), ("character", "@엑"), ("scene", "# 나"), ("action", "extra")])
    aligned = repair.realigned(source, result)
    assert [r.result for r in aligned.orderBy("block_no").collect()] == ["위", "# 가", "1 2", "3", "@엑", None, "# 나 extra"]
    assert [r.source for r in repair.gaps(aligned).orderBy("block_no").collect()] == ["d"]


def test_korean_scripts(spark):
    text = "은주 - 스무 살\n성현 - 형\n#1. 집\n은주 어디 가요?\n은주가 걷는다.\n성현의 목소리> 나야\n잘 있어?\n은주는 본다.\n성현 (웃으며) 왔네\n\n문이 열린다.\n은주(27세), 서 있다."
    got = [(r.type, r.text) for r in korean.korean_lines(lines(spark, text)).orderBy("line_no", "part").collect()]
    assert got == [
        ("scene", "# 1. 집"), ("character", "@은주"), ("dialogue", "- 어디 가요?"), ("action", "은주가 걷는다."), ("character", "@성현 (소리)"), ("dialogue", "- 나야"), ("dialogue", "- 잘 있어?"),
        ("action", "은주는 본다."), ("character", "@성현"), ("paren", "(웃으며)"), ("dialogue", "- 왔네"), ("action", "문이 열린다."), ("action", "은주(27세), 서 있다."),
    ]
    runs = lines(spark, "風林火山\nx 風林火山\ny 風林火山 z")
    assert [(r.key, r.n) for r in korean.title_runs(runs).collect()] == [("風林火山", 3)] and texts_of(korean.without_title_runs(runs)) == ["風林火山", "x", "y  z"]
    names = korean.names_by_endings(lines(spark, "민수 어디 가니\n민수 왔어요\n그는 왔어요\n그는 갔어요\n영희 문을 연다\n영희 본다"))
    assert [(r.name, r.n) for r in names.collect()] == [("민수", 2)]


def test_file_layers(spark):
    rows = [("a", p, 100, False, ["Courier"]) for p in range(1, 11)] + [("b", p, 2, True, []) for p in range(1, 11)] + [("c", p, 90, True, ["Arial"]) for p in range(1, 11)] + [("d", p, 90, False, ["GlyphLessFont"]) for p in range(1, 3)]
    pages = spark.createDataFrame(rows, "work string, page int, items int, image boolean, fonts array<string>")
    assert {(r.work, r.verdict) for r in layout.layer_kinds(pages).collect()} == {("a", "text"), ("b", "none"), ("c", "scan"), ("d", "read")}


def test_headers_of_revised_pages_by_hand(spark):
    headers = [
        "10/6/03 MM revs. (pink) 1A.", "The Red Planet Shooting Script 5.", "화성인 촬영 대본 13.", "SALMON #2 XX/XX/07 6A.", "MEMORY Blue Revisions – 8/27/99", "MEMORY - Green Revisions 10-4-99 12 CONTINUED: (2)",
        "기억 블루 리비전 – 8/27/9", "Blue Rev. (mm/dd/yy) 66.", "Blue Rev. (June 11, 17) 7.", '"BLUE SKY" CONFORMED SCRIPT 1.9.2025 Pg. 11', "PINK SHOOTING SCRIPT (JUNE 17, 2024) 60DA.", "COLD BAY - Ep. 210 - Full Goldenrod - 02/03/24 10.",
        "THE QUEEN SHOOTING SCRIPT 6 MAR 17 (BLUE REVISIONS 14 MAR 17) 20.", "2. blue rev. 3-10-21 3. blue rev. 3-10-21", "Tan Rev. (Jan 31 '18) - 1518 3bA.", "MOVED TO SC 230A", "MERGED INTO SC 281256", "KOTM - Final Shooting Script - August 10, 2022 143.",
        "THE MATTER - May 3rd 2022 - 2 - ...sc", "Blue Pictures 43-45 Some Street London W1T 1RS", 'CALL HIM #613 "All Gone" FINAL 1/19/22 9.', "Pink Revised 07/15/2016 39A.", "BLUE WIP REVISIONS SZ EPISODE 1 19.", "SCENE MOVED AND RE-NUMBERED TO SCENE 162",
        "Sc.66D Full Pink 11.16.2023", "Sc. Full Pink 11.16.2023", "BUFF REVISED, MAY 11, 2015 88-89A.", "Goldenrod Pages - 8.29.2016 47-47A.", "GOLDENROD REVISIONS (11/17/21) 68-69.", "GG - Pink Revised 9/.15/13 96A.", "Some Figures - 5/9/2016 - Shooting Draft - 68 .",
        "1/24/13 FINAL SHOOTING SCRIPT 121.", "FILMHOUSE.COM/AWARDS Released by Some Century House © 2013 Some Century House", "OMITTED85-89A 85-89A", "OMITTED (NOW SC. 110A) 108", "OMITTEDMOVED TO 65A",
    ]
    plain = ["He paints it blue and leaves.", "She reads the script on May 3.", "OMITTING nothing, he goes.", "They moved to Scotland.", "The Shooting starts at 5.", "PINK FLOYD plays.", "Draft beer, 3 glasses.", "12. EXT. ROAD - NIGHT", "Revisions are due in March."]
    rows = spark.createDataFrame([("h", i, x) for i, x in enumerate(headers)] + [("p", i, x) for i, x in enumerate(plain)] + [("m", 0, f"- so it goes. {headers[0]}")], "work string, line_no int, text string")
    got = {}
    for x in repair.without_script_headers(rows).orderBy("work", "line_no").collect():
        got.setdefault(x.work, []).append(x.text)
    assert got.get("h", []) == [] and got["p"] == plain and got["m"] == ["- so it goes."]


def test_narration_about_named_people(spark):
    rows = spark.createDataFrame([("Willa opens the door.",), ("He opens the door.",), ("Willa and I go.",)], "t string")
    assert [x[0] for x in rows.select(S.is_english_narration(F.col("t"))).collect()] == [False, True, False]
    assert [x[0] for x in rows.select(S.is_english_narration(F.col("t"), ("Willa",))).collect()] == [True, True, False]
