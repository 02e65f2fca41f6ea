"""Readers of scripts, subtitles, reading results, notes and job files. Each gives rows; none collects."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import text as X
from ..operators import clean

SCENE = "struct<id:int,raw:string,formatted:string,translated:string,tokens:struct<format_in:int,format_out:int,translate_in:int,translate_out:int>,status:string,error:string,heading:string>"
JOB = f"id string, title string, phase string, status string, startTime bigint, activeMs bigint, profile struct<weight:string,latitude:string,flags:array<string>,synopsis:string,nameMap:map<string,string>,toneGuide:string>, scenes array<{SCENE}>"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, work, text): whole text files; the work is the folder of a file."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.withColumn("work", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))


def scripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, work, text): scripts by the kind of their file: RTF and XML lose their markup, others are read as they are."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    plain = F.when(kind == "rtf", clean.strip_rtf(F.col("text"))).when(kind.isin("fdx", "xml", "html"), clean.strip_markup(F.col("text"))).otherwise(F.col("text"))
    return texts(spark, path).withColumn("text", plain)


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job files: a row per job, with its scenes as an array."""
    return spark.read.schema(JOB).option("multiLine", True).json(path)


def recovered(rows: DataFrame) -> DataFrame:
    """Jobs as they go on after a stop: scenes in work are put back to the state before."""
    status = lambda s: F.when(s == "formatting", "pending").when(s == "translating", "formatted").otherwise(s)
    return rows.withColumn("scenes", F.transform("scenes", lambda s: s.withField("status", status(s["status"]))))


def process_log(spark: SparkSession, path: str, schema: str = "ts timestamp, level string, work string, event string, detail string") -> DataFrame:
    """The append-only log of JSON lines."""
    return spark.read.schema(schema).json(path)


def decode_subtitle(data: bytes) -> str:
    """Text of a subtitle file: by byte-order mark, else UTF-8 if valid, else UTF-16 if much of the start is NUL, else the Korean code page."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data[2:].decode("utf-16-le" if data[0] == 0xFF else "utf-16-be", "replace")
    try:
        return data.decode("utf-8").removeprefix("﻿")
    except UnicodeDecodeError:
        start = data[:4000]
        odd, even = start[1::2].count(0), start[::2].count(0)
        if odd + even > 0.15 * len(start):
            return data.decode("utf-16-le" if odd > even else "utf-16-be", "replace")
        return data.decode("cp949", "replace")


def decoded(content: Column) -> Column:
    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None else decode_subtitle(bytes(b)))

    return decode(content)


def subtitle_lines(files: DataFrame, content: str = "content", work: str = "work") -> DataFrame:
    """(work, line_no, text): what is said in subtitles of the three kinds, without times and tags."""
    t = F.regexp_replace(decoded(F.col(content)), "[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{D}\\x{E}-\\x{1F}\\x{FEFF}]", "")
    rows = files.select(F.col(work).alias("work"), t.alias("t"))
    sync = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", r"(?i)<SYNC[^>]*>", "\n"), r"<[^>]+>", ""), r"(?i)&nbsp;", " ")
    timed = F.filter(F.split("t", "\n"), lambda x: ~X.has(X.trim(x), r"^\d+$") & ~F.contains(x, F.lit("-->")))
    timed = F.transform(timed, lambda x: F.regexp_replace(x, r"<[^>]+>", ""))
    pieces = F.when(F.col("t").rlike("(?i)<SYNC"), F.split(sync, "\n")).when(F.contains("t", F.lit("-->")), timed).otherwise(F.split("t", "\n"))
    said = F.filter(F.transform(pieces, X.trim), lambda x: x != "")
    return rows.select("work", F.posexplode(said).alias("line_no", "text"))


def korean_entries(lines: DataFrame) -> DataFrame:
    """Subtitle lines that are Korean and longer than one character."""
    return lines.filter((F.length("text") > 1) & X.has(F.col("text"), "[가-힣]"))


def reading_lines(spark: SparkSession, path: str) -> DataFrame:
    """(page, x, y, text): a list of read lines, one per row with tabs; further tabs belong to the text."""
    parts = F.split("value", "\t", 4)
    return spark.read.text(path).filter("value <> ''").select(parts[0].cast("int").alias("page"), parts[1].cast("double").alias("x"), parts[2].cast("double").alias("y"), parts[3].alias("text"))


def reading_words(spark: SparkSession, path: str, least: float = 40.0) -> DataFrame:
    """(page, line_no, x, y, text): lines from a table of read words with confidence: sure words of one block, paragraph and line, by their left edge."""
    names = ["level", "page", "block", "par", "line", "word", "left", "top", "width", "height", "conf", "text"]
    schema = T.StructType([T.StructField(n, T.StringType() if n == "text" else T.DoubleType()) for n in names])
    rows = spark.read.schema(schema).csv(path, sep="\t", header=True, quote="").filter((F.col("conf") >= least) & (F.trim("text") != ""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda x: x["text"])
    lines = rows.groupBy("page", "block", "par", "line").agg(F.min("left").alias("x"), F.min("top").alias("y"), F.array_join(ordered, " ").alias("text"))


    return lines.select(F.col("page").cast("int").alias("page"), (F.row_number().over(W.partitionBy("page").orderBy("y", "x")) - 1).alias("line_no"), "x", "y", "text")


def indented_lines(lines: DataFrame) -> DataFrame:
    """Lines with x: their leading spaces, in place of coordinates."""
    return lines.withColumn("x", X.indent(F.col("text")).cast("double"))


def positioned_items(files: DataFrame, read: Callable[[bytes], Iterator[tuple[int, int, str, float, float, float]]], work: str = "work", content: str = "content") -> DataFrame:
    """(work, page, seq, str, x, y, width): text items of page files; `read` is any PDF library behind a function from bytes to items."""

    def items(batches):
        for pdf in batches:
            rows = [(w, *item) for w, c in zip(pdf[work], pdf[content], strict=True) for item in read(bytes(c))]
            yield pd.DataFrame(rows, columns=["work", "page", "seq", "str", "x", "y", "width"])

    return files.select(work, content).mapInPandas(items, "work string, page int, seq int, str string, x double, y double, width double")


def feedback(texts: DataFrame, work: str = "work", text: str = "text") -> DataFrame:
    """(work, item_no, scene, kind, source, target, edited, marks): items of review feedback, each a block after a line of dashes."""
    blocks = F.slice(F.split(F.regexp_replace(F.col(text), "\r", ""), "\n---\n"), 2, 1 << 20)
    rows = texts.select(F.col(work).alias("work"), F.posexplode(blocks).alias("item_no", "block"))
    head = r"(?m)^\s*\[씬\s*(.+?)\s*·\s*(.+?)\]\s*$"
    field = lambda name: F.nullif(X.trim(F.regexp_extract("block", rf"(?m)^\s*{name}:(.*)$", 1)), F.lit(""))
    mark = r"^●\s*\[(.+?)\]\s*(?:—\s*(.*))?$"
    lines = F.filter(F.transform(F.split("block", "\n"), X.trim), lambda x: x.rlike(mark))
    tags = lambda x: F.filter(F.transform(F.split(F.regexp_extract(x, mark, 1), "·"), X.trim), lambda t: t != "")
    marks = F.transform(lines, lambda x: F.struct(tags(x).alias("tags"), X.trim(F.coalesce(F.regexp_extract(x, mark, 2), F.lit(""))).alias("memo")))
    none = lambda c: F.nullif(c, F.lit(""))
    rows = rows.select("work", "item_no", none(F.regexp_extract("block", head, 1)).alias("scene"), none(F.regexp_extract("block", head, 2)).alias("kind"), field("원문").alias("source"), field("번역").alias("target"), field("수정됨").alias("edited"), marks.alias("marks"))
    return rows.filter(F.col("target").isNotNull() | F.col("edited").isNotNull())


def direct_edits(items: DataFrame) -> DataFrame:
    return items.filter(F.col("edited").isNotNull() & F.col("target").isNotNull())


def open_marks(items: DataFrame) -> DataFrame:
    return items.filter(F.col("edited").isNull() & (F.size("marks") > 0))


def review_sections(texts: DataFrame, work: str = "work", text: str = "text") -> DataFrame:
    """(work, name, id, body): the `=== name (id: x) ===` sections of review notes."""
    head = r"===\s*(.+?)\s*\(id:\s*([^)]+)\)\s*==="
    parts = F.split(F.col(text), r"(?m)(?====\s*.+?\(id:)")
    rows = texts.select(F.col(work).alias("work"), F.explode(parts).alias("part")).filter(F.col("part").rlike(head))
    return rows.select("work", F.regexp_extract("part", head, 1).alias("name"), X.trim(F.regexp_extract("part", head, 2)).alias("id"), X.trim(F.regexp_replace("part", head, "")).alias("body"))


def json_array_in(text: Column, schema: str) -> Column:
    """The JSON array that stands somewhere in a free text."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\[.*\])", 1), schema)
