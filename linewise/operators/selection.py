"""Samples, top rows, budgets and status tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T


def systematic_sample(rows: DataFrame, cap: int, *order: Column | str, by: str = "work") -> DataFrame:
    """At most `cap` rows of each work, evenly spread: those at floor(k x n / cap)."""
    numbered = rows.withColumn("__rn", F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(by)))
    step = F.col("__n") / F.lit(float(cap))
    # row r is taken if some k has floor(k x step) = r: the least k with k x step >= r is the only one to try
    k = F.ceil(F.col("__rn") / step)
    taken = (F.col("__n") <= cap) | ((F.floor(k * step) == F.col("__rn")) & (k < cap)) | ((F.floor((k - 1) * step) == F.col("__rn")) & (k >= 1))
    return numbered.filter(taken).drop("__rn", "__n")


def budget_sample(rows: DataFrame, size: Column, budget: int, step: int, *order: Column | str, by: str = "work") -> DataFrame:
    """Every step-th row of each work until the first that would exceed the budget."""
    numbered = rows.withColumn("__rn", F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1).filter(F.pmod("__rn", F.lit(step)) == 0)
    total = F.sum(size).over(W.partitionBy(by).orderBy("__rn").rowsBetween(W.unboundedPreceding, 0))
    return numbered.withColumn("__total", total).filter(F.col("__total") <= budget).drop("__rn", "__total")


def head_sample(lines: DataFrame, n: int = 40, longest: int = 2000) -> DataFrame:
    """(work, sample): the first n non-blank lines of each work, cut at `longest` characters: a feature of the report."""
    rows = lines.filter(F.trim("text") != "").withColumn("rn", F.row_number().over(W.partitionBy("work").orderBy("line_no"))).filter(F.col("rn") <= n)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda x: x["text"])
    return rows.groupBy("work").agg(F.substring(F.array_join(ordered, "\n"), 1, longest).alias("sample"))


def top(rows: DataFrame, n: int, *order: Column | str, by: str | None = None) -> DataFrame:
    """The first n rows, overall or of each group: a report, whose limit is its meaning."""
    if by is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def slice_at(rows: DataFrame, part: Column, parts: Column, width: Column, by: str = "work", order: str = "line_no") -> DataFrame:
    """The `width` rows of each work around the place that is part / parts of the way through it."""
    numbered = rows.withColumn("__rn", F.row_number().over(W.partitionBy(by).orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(by)))
    centre = F.floor(part / F.greatest(parts, F.lit(1)) * F.col("__n"))
    low = F.greatest(F.lit(0), centre - F.floor(width / 2))
    return numbered.filter((F.col("__rn") >= low) & (F.col("__rn") < low + width)).drop("__rn", "__n")


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The latest row of each key, as an aggregate: a key with many rows is reduced where they lie."""
    others = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("b"))
    return best.select(key, "b.*")


def latest_n(rows: DataFrame, n: int, by: list[str], *order: Column, parts: int = 64) -> DataFrame:
    """The first n rows of each key in an order, with their rank: the last n of a log where the order is descending.

    A bounded top-n that merges: each task keeps n rows of a key, then each of `parts` shares of a key, then the key. So a key with any part of all rows never has more than
    parts x n rows in one task. Rows that the order leaves equal are ranked by all their columns.
    """
    ties = [F.col(c) for c in rows.columns if not rows.schema[c].dataType.simpleString().startswith("map")]
    share = F.pmod(F.xxhash64(*ties), F.lit(parts))
    for own in ([*by, share], by):
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*own).orderBy(*order, *ties))).filter(F.col("rank") <= n)
        if own is not by:
            rows = rows.drop("rank")
    return rows


def upsert(old: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    return latest(old.unionByName(new), key, *order)


def status_rollup(scenes: DataFrame, by: str, status: Column) -> DataFrame:
    """(by, total, done, errors): how far the scenes of a job are; status text that starts with `error` is one."""
    return scenes.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.sum((status == "done").cast("long")).alias("done"), F.sum(status.startswith("error").cast("long")).alias("errors"))


def active_time(events: DataFrame, key: str, at: str, running: Column, *tie: str) -> DataFrame:
    """(key, active_seconds): time from each running event to the next event of its key."""
    order = W.partitionBy(key).orderBy(at, *tie)
    rows = events.withColumn("__next", F.lead(at).over(order)).filter(running & F.col("__next").isNotNull())
    # microseconds as integers, so that sums do not depend on their order
    us = F.unix_micros(F.col("__next").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return rows.groupBy(key).agg((F.sum(us) / 1000000).alias("active_seconds"))


def error_groups(rows: DataFrame, message: Column, id_col: str) -> DataFrame:
    """(class, n, first_id, last_id): failures by kind; the class of each row is text.error_class."""
    return rows.select(T.error_class(message).alias("class"), id_col).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))


def token_cost(scenes: DataFrame, price_in: float = 3.0, price_out: float = 15.0) -> DataFrame:
    """(id, tokens_in, tokens_out, cost): totals of a job's scenes; prices are per million tokens."""
    t = F.col("s.tokens")
    rows = scenes.select("id", F.explode("scenes").alias("s")).groupBy("id").agg(F.sum(t.format_in + t.translate_in).alias("tokens_in"), F.sum(t.format_out + t.translate_out).alias("tokens_out"))
    return rows.withColumn("cost", (F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6)


def outage(rows: DataFrame, by: str, failed: Column) -> DataFrame:
    """(by, n, failures, outage): an outage is two failures and half of all, or more."""
    s = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("failures"))
    return s.withColumn("outage", F.col("failures") >= F.greatest(F.lit(2.0), F.col("n") * 0.5))
