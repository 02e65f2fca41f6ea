"""Exact dedup by progressive refinement, in DataFrame operations only.

Groups of possibly equal texts are refined three times: by length, by a hash of a prefix, by a hash of the whole text. Each
step looks only at rows whose group still has two rows, so a text of unique length is never hashed for grouping. No step
moves a text: the shuffled rows hold an id, a length and hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, text_or_empty, without, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged. For texts of ASCII alone, lower() does that and is much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: the id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. The row with the largest id of a
    group stays. text_sha256 is the digest of the normalised text; without digest_all it is null for rows that needed none.

    Defined cases: no rows give no rows. A null id is smaller than any other, and stays only if all ids of its group are
    null. Rows that repeat an id and a text all count in group_size and share the same `kept`. Other columns are ignored,
    whatever their names.
    """
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("n", F.octet_length("t"))  # lower-casing A-Z keeps the length

    def repeated(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(*keys, F.lit(True).alias("again"))

    lengths = if_small(written(repeated(base, "n"), "lengths"))
    prefix = F.xxhash64(ascii_lower(F.substring("t", 1, prefix_chars)))
    by_prefix = base.join(lengths, "n", "left").select("id", "t", "n", F.when(F.col("again"), prefix).alias("p"))
    prefixes = if_small(written(repeated(by_prefix.filter("p is not null").select("n", "p"), "n", "p"), "prefixes"))

    digest = F.sha2(F.encode(ascii_lower(F.col("t")), "UTF-8"), 256)
    if digest_all:  # every digest is wanted anyway: take it in the scan, and no text is shuffled if the groups are too many to broadcast
        keyed = by_prefix.select("id", "n", "p", digest.alias("sha"))
        refined = keyed.join(prefixes, ["n", "p"], "left").select("id", "n", "p", "sha", F.col("again"))
    else:
        keyed = by_prefix.join(prefixes, ["n", "p"], "left")
        refined = keyed.select("id", "n", "p", F.when(F.col("again"), digest).alias("sha"), "again")
    refined = written(refined, "refined")

    groups = (
        refined.filter("again").groupBy("n", "p", "sha")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1").withColumnRenamed("sha", "group_sha").withColumnRenamed("n", "gn").withColumnRenamed("p", "gp")
    )
    # a group may hold a third of all rows: as a table of its own it is broadcast, or else adaptive execution can split the join's exchanges
    groups = if_small(written(groups, "groups"))
    joined = refined.join(groups, (F.col("sha") == F.col("group_sha")) & (F.col("n") == F.col("gn")) & (F.col("p") == F.col("gp")), "left")
    in_group = F.col("group_size").isNotNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(in_group, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(in_group, F.col("id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of exact_dedup, one with the largest id; all columns stay. A row is named by its id and normalised text.

    Defined cases: no rows give no rows. A null text is equal to an empty one. A null id is smaller than any other. Of rows that repeat the id and the
    text that stay, the one with the least hash of its columns stays.
    """
    judged = exact_dedup(docs, id_col, text_col, **options | {"digest_all": True})
    named = judged.groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("of_text"), "kept").agg(F.count(F.lit(1)).alias("rows"))
    named = written(named, "exact-named")
    digest = F.sha2(F.encode(ascii_lower(text_or_empty(text_col)), "UTF-8"), 256)
    return without(docs, named.filter("not kept"), named.filter("kept and rows > 1"), id_col, digest)


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
