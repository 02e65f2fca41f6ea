"""Sinks. Spark's committer makes each all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_texts(texts: DataFrame, path: str) -> None:
    """(work, text) as text files in a folder per work."""
    texts.select("work", F.col("text").alias("value")).write.mode("overwrite").partitionBy("work").option("lineSep", "\n").text(path)


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """The works whose text is not what it was: only these need writing."""
    before = old.select("work", F.sha2("text", 256).alias("was"))
    return new.join(before, "work", "left").filter(~F.sha2("text", 256).eqNullSafe(F.col("was"))).drop("was")


def rendered(blocks: DataFrame) -> DataFrame:
    """(work, text): blocks one blank line apart, with a line break at the end."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"])
    return blocks.groupBy("work").agg(F.concat(F.array_join(ordered, "\n\n"), F.lit("\n")).alias("text"))


def overlay(edits: DataFrame) -> DataFrame:
    """(work, json): the edits (work, block, text) of a work as one object."""
    return edits.groupBy("work").agg(F.to_json(F.struct(F.col("work").alias("id"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("block", "text")))).alias("edits"))).alias("json"))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_new(rows: DataFrame, known: DataFrame, path: str, *keys: str) -> None:
    """Rows whose key is not known yet, added to an allow list."""
    rows.join(known, list(keys), "left_anti").write.mode("append").json(path)


def backup_usage(files: DataFrame) -> DataFrame:
    """(files, bytes) of paths that look like backups; files have (path, length). Nothing is deleted."""
    return files.filter(F.col("path").rlike(r"(?i)\.[a-z]*bak[^/]*$")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def quarantine(lines: DataFrame, doubtful, path: str) -> DataFrame:
    """Write doubtful lines (work, text) aside, tab-separated, and return the others."""
    lines.filter(doubtful).select(F.concat_ws("\t", "work", "text").alias("value")).write.mode("overwrite").text(path)
    return lines.filter(~doubtful)
