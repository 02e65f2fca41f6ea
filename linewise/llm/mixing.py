"""Mixing sources to target weights by weighted fair queueing.

The documents of each source are shuffled into a queue. A document's virtual finish time is the number of its source's words
up to and with it, divided by the source's target; the second round through a source continues where the first ended. All
documents of all sources, ordered by that time, are taken until the budget is used up.

Running totals never need a source, or all rows, in one task: each queue is cut into bins of its shuffle key, whose number grows with the
rows; a bin's total is a small row, and only rows of one bin are ordered together. The total over all sources in time order is narrowed down
by slots of time in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, text_or_empty, written

#: Weights of the sources in code-point order, repeating, and the share of all words that the mix has.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2


def shuffle_key(id_col: Column, seed: int) -> Column:
    """60 bits that depend on the id and the seed alone; md5 is the same in every engine."""
    return F.conv(F.substring(F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), "UTF-8")), 1, 15), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """totals (source, source_size) with `target`: share x all words by weight, none above repeats x its size.

    Where a target stops there, what is left over goes to the others by weight, until none is above: with the sources ordered by
    the level at which they stop, one pass finds those that do. The table has a row per source, so it is ordered in one task.
    """
    by_name, by_level, everything = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("level", "nth"), W.partitionBy()
    rows = totals.withColumn("nth", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("stop", F.col("source_size") * repeats).withColumn("level", F.col("stop") / F.col("weight").cast("double"))
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    left_over = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("stop").over(before), F.lit(0))
    weight_left = F.sum("weight").over(by_level.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("fill", left_over / weight_left).withColumn("stops", F.col("level") <= F.col("fill"))
    fill = F.max(F.when(~F.col("stops"), F.col("fill"))).over(everything)  # the first that does not stop has the final, largest level
    target = F.when(F.col("stops"), F.col("stop").cast("double")).otherwise(fill * F.col("weight"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE, seed: int = 0, rows_a_bin: int = 100_000, rows_in_order: int = 100_000,
) -> DataFrame:
    """One row per row of docs: id, size, source, source_size, target, copies (0, 1 or 2) and taken.

    size is the number of words (runs of anything but ASCII blanks), 0 for null. The result depends on ids, sizes, sources
    and the seed alone, so reruns agree.

    Defined cases: no rows give no rows. Null is a source of its own, the last. A source without words has target 0 and
    takes nothing. Documents without words are never taken. Rows that repeat an id and a size are ordered
    together, which of them comes first makes no difference to any column but `copies`.
    """
    words = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words.alias("size")).withColumn("key", shuffle_key(F.col("id"), seed))
    base = base.withColumns({"named": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})
    base = written(base, "mix-sizes")
    bits = max(12, (base.count() // rows_a_bin).bit_length())  # bins of a queue: their number grows with the rows
    base = base.withColumn("bin", F.shiftright("key", 60 - bits))

    queue_keys = ["none", "named", "bin"]
    bin_totals = written(base.groupBy(*queue_keys).agg(F.sum("size").alias("words")), "mix-bins")
    totals = bin_totals.groupBy("none", "named").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals.withColumn("source", F.when(~F.col("none"), F.col("named"))), weights, share).select(
        F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("named"), "source_size", "target",
    )
    targets = written(targets, "mix-targets")  # a row per source
    earlier = F.coalesce(F.sum("words").over(W.partitionBy("none", "named").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = written(bin_totals.select(*queue_keys, earlier.alias("before")).join(targets, ["none", "named"]), "mix-offsets")

    # the window and the join deal rows out by the same keys: one exchange of small rows
    in_bin = W.partitionBy(*queue_keys).orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, 0)
    queue = base.withColumn("in_bin", F.sum("size").over(in_bin)).join(offsets, queue_keys)
    reached = F.col("before") + F.col("in_bin")
    time = lambda words: F.when((F.col("target") > 0) & (F.col("size") > 0), words / F.col("target"))
    queue = written(queue.select("id", "source", "size", "key", "source_size", "target", time(reached).alias("time1"), time(F.col("source_size") + reached).alias("time2")), "mix-queue")

    end = budget_end(queue, float(targets.agg(F.sum("target")).first()[0] or 0), rows_in_order)
    until = lambda time: time.isNotNull() & ((time < end[0]) | ((time == end[0]) & (F.col("key") <= end[1])))
    copies = F.when(until(F.col("time1")), 1).otherwise(0) + F.when(until(F.col("time2")), 1).otherwise(0)
    return queue.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def budget_end(queue: DataFrame, budget: float, rows_in_order: int = 100_000, slots: int = 4096) -> tuple[float, int]:
    """(time, key) of the last document, in order of time and key, with which the words of all are within the budget.

    The range of times that holds the end is cut into slots, whose totals say in which of them it lies, and so on until that has no more than
    rows_in_order rows or one time alone: only these are put in order, as a top-k of running totals. Each pass is one aggregation.
    """
    times = F.array(F.struct(F.lit(1).alias("round"), F.col("time1").alias("time")), F.struct(F.lit(2).alias("round"), F.col("time2").alias("time")))
    rows = queue.select("id", "size", "key", F.explode(times).alias("t")).select("id", "size", "key", "t.round", "t.time").filter("time is not null")
    low, high, n, words = rows.agg(F.min("time"), F.max("time"), F.count(F.lit(1)), F.sum("size")).first()
    before = 0
    if not n or words <= budget:
        return float("inf"), 0
    while n > rows_in_order and high > low:
        at = F.least(F.floor((F.col("time") - F.lit(low)) / F.lit((high - low) / slots)), F.lit(slots - 1)).cast("int")
        totals = rows.filter((F.col("time") >= low) & (F.col("time") <= high)).groupBy(at.alias("slot"))
        totals = totals.agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("time").alias("low"), F.max("time").alias("high"))
        for slot in sorted(totals.collect(), key=lambda r: r.slot):  # as many rows as slots at most
            if before + slot.words > budget:
                low, high, n = slot.low, slot.high, slot.n
                break
            before += slot.words
    within = rows.filter((F.col("time") >= low) & (F.col("time") <= high))
    if n > rows_in_order:  # one time of very many rows: their keys in bins
        width = 1 << 60
        first = 0
        while n > rows_in_order and width > 1:
            width //= slots
            keyed = within.filter((F.col("key") >= first) & (F.col("key") < first + width * slots)).groupBy(F.floor((F.col("key") - F.lit(first)) / F.lit(width)).alias("slot"))
            for slot in sorted(keyed.agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r.slot):
                if before + slot.words > budget:
                    first, n = first + int(slot.slot) * width, slot.n
                    break
                before += slot.words
        within = within.filter((F.col("key") >= first) & (F.col("key") < first + width))
        if n > rows_in_order:  # rows of one key: none of them goes without the others
            return low, first - 1
    order = W.orderBy("time", "key", F.col("id").asc_nulls_first(), "size", "round").rowsBetween(W.unboundedPreceding, 0)
    last = within.withColumn("total", F.sum("size").over(order) + before).filter(F.col("total") <= budget).agg(F.max(F.struct("time", "key"))).first()[0]
    return (last.time, last.key) if last else (low, -1)


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix takes it; all columns stay.

    Defined cases: those of mix_sources. Rows that repeat an id, size and source are all taken as often as the least of them.
    """
    mixed = mix_sources(docs, id_col, text_col, source_col, **options).filter("copies > 0")
    mixed = mixed.groupBy(F.col(id_col).alias("__id"), F.col("size").alias("__size"), F.col("source").alias("__source")).agg(F.min("copies").alias("__copies"))
    size = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (size == F.col("__size")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
    taken = docs.join(mixed, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return taken.select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, CASE nth % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS stop FROM s),
l AS (SELECT *, stop / CAST(weight AS DOUBLE) AS level, sum(source_size) OVER () AS all_size FROM w),
f AS (SELECT *, (CAST(all_size AS DOUBLE) * 1.5 - coalesce(sum(stop) OVER (ORDER BY level, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY level, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fill FROM l),
t AS (SELECT source, source_size, CASE WHEN level <= fill THEN CAST(stop AS DOUBLE) ELSE (SELECT max(fill) FROM f WHERE NOT level <= fill) * weight END AS target FROM f),
q AS (SELECT d.*, t.source_size, t.target,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reached
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, size, key, 1 AS round, reached / target AS vt FROM q WHERE size > 0 AND target > 0
      UNION ALL SELECT doc_id, size, key, 2, (source_size + reached) / target FROM q WHERE size > 0 AND target > 0),
g AS (SELECT doc_id, size, sum(size) OVER (ORDER BY vt, key, doc_id, size, round ROWS UNBOUNDED PRECEDING) AS total FROM e),
n AS (SELECT doc_id, sum(size) AS taken FROM g WHERE total <= (SELECT sum(target) FROM t) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(n.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN n USING (doc_id)
"""
