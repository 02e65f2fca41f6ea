"""Pages as a data source, and versions of a table that a broken write leaves as they were."""

import pytest
from pyspark.sql import functions as F

from linewise.sources import pages, versions


def tabbed(rows):
    return "".join("\t".join(map(str, r)) + "\n" for r in rows)


@pytest.fixture()
def folder(tmp_path):
    rows = []
    for page in range(1, 12):
        lines = [(100, 700, f"MY SCRIPT {page}"), (121, 680, f"INT. {chr(64 + page)}LEY - DAY"), (128, 678.5, f" {page}"), (100, 650, " "), (149, 640, "He walks."), (190, 620, "CUT TO:"), (100, 600, "FADE IN THE ROOM"), (100, 590, f"THE {chr(64 + page)}LEY HOUSE"), (100, 100, f"{page}.")]
        rows += [(page, i, x, y, 10, t) for i, (x, y, t) in enumerate(lines)]
    (tmp_path / "my.tsv").write_text(tabbed(rows) + "a broken line\n1\tx\n")
    (tmp_path / "other.tsv").write_text(tabbed([(1, 0, 5, 5, 5, "a\tb"), (1, 1, 9, 5, 5, "c")]))
    return tmp_path


def load(spark, folder, **options):
    spark.dataSource.register(pages.PageItems)
    return spark.read.format("page_items").options(**options).load(str(folder))


def test_pages_are_read_by_ranges(spark, folder):
    items = load(spark, folder, pages_a_task="4")
    assert items.rdd.getNumPartitions() == 4  # eleven pages by four, and one
    rows = items.orderBy("work", "page", "seq").collect()
    assert len(rows) == 11 * 9 + 2 and {r.work for r in rows} == {"my", "other"} and rows[-2].str == "a\tb"
    assert load(spark, folder / "other.tsv", parser="linewise.sources.pages:TABBED").count() == 2
    assert {r.work: r.text for r in pages.joined_words(items.filter("page = 1")).collect()}["other"] == "a\tb c"


def test_an_empty_folder_has_no_items(spark, tmp_path):
    assert load(spark, tmp_path).count() == 0


def test_lines_wait_for_text_and_stand_at_their_first(spark, folder):
    lines = pages.composed_lines(load(spark, folder).filter("work = 'my' AND page = 1")).orderBy("line_no").collect()
    assert [(x.x, x.text) for x in lines] == [(100, "MY SCRIPT 1"), (121, "INT. ALEY - DAY 1"), (100, " He walks."), (190, "CUT TO:"), (100, "FADE IN THE ROOM"), (100, "THE ALEY HOUSE"), (100, "1.")]


def test_readings_are_indented_and_marked(spark, folder):
    rows = pages.reading(load(spark, folder).filter("work = 'my'")).orderBy("line_no").collect()
    assert len(rows) == 11 * 6 and [x.line_no for x in rows] == list(range(len(rows)))  # the header has gone; a number alone has no signature
    assert [(x.text, x.candidate) for x in rows[:6]] == [("   INT. ALEY - DAY 1", True), ("He walks.", False), (" " * 13 + "CUT TO:", False), ("FADE IN THE ROOM", False), ("THE ALEY HOUSE", True), ("1.", False)]


def test_versions_follow_each_other_and_go_back(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/t")
    frame = lambda *rows: spark.createDataFrame(rows, "work string, text string")
    with pytest.raises(ValueError):
        store.read()
    assert [store.write(frame(("a", "1"), ("b", "1"))), store.write(frame(("a", "2"), ("b", "1"), ("c", "1")), "second")] == [1, 2]
    texts = lambda v=None: {r.work: r.text for r in store.read(v).collect()}
    assert texts() == {"a": "2", "b": "1", "c": "1"} and texts(1) == {"a": "1", "b": "1"} and store.manifest(2)["note"] == "second"
    assert {r.work for r in store.changed(2, 1).collect()} == {"a", "c"}
    assert store.back_to(1) == 3 and texts() == texts(1)
    with pytest.raises(ValueError):
        store.read(9)


def test_a_broken_write_leaves_the_last_version(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([("a", "1")], "work string, text string")
    store.write(rows)
    with pytest.raises(Exception, match="no more"):
        store.write(rows.withColumn("text", F.when(F.col("work") == "a", F.raise_error(F.lit("no more"))).otherwise("")))
    assert store.numbers() == [1] and store.read().collect() == rows.collect()
    assert store.write(rows.withColumn("text", F.lit("2"))) == 2


def test_of_two_writers_one_has_to_try_again(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([("a", "1")], "work string, text string")
    store.write(rows)
    store.write(rows.withColumn("text", F.lit("2")), after=1)
    with pytest.raises(versions.Conflict):
        store.write(rows.withColumn("text", F.lit("3")), after=1)
    assert store.read().first().text == "2" and store.numbers() == [1, 2]


def test_old_versions_are_forgotten_but_the_first(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/t")
    rows = lambda x: spark.createDataFrame([("a", x)], "work string, text string")
    for x in "12345":
        store.write(rows(x))
    store.back_to(2)
    assert store.forget(keep=2) == 2 and store.numbers() == [1, 5, 6]
    assert [store.read(n).first().text for n in store.numbers()] == ["1", "5", "2"]
