"""Two-pass external shuffle into shards.

Pass one scatters the records with seeded hashes into buckets that fit in memory; pass two shuffles each bucket by
Fisher-Yates and writes it. A shard is a run of buckets, so shards may be far larger than a task's memory. The shard of a
record follows from its id and the number of shards alone, by jump consistent hashing: one more shard takes records only
into itself.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import if_small, mixed, new_folder, text_or_empty, written

#: Bytes that a record counts beside its text.
RECORD_BYTES = 16
#: The multiplier of the published jump consistent hash (Lamping and Veach, 2014).
JUMP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys, all keys at a time: each round moves on those that still jump within the shards."""
    keys = keys.astype(np.uint64)
    at, ahead = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    moving = ahead < shards
    while moving.any():
        at[moving] = ahead[moving]
        keys[moving] = keys[moving] * JUMP + np.uint64(1)
        draw = (keys[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[moving] = np.floor((at[moving] + 1) * (2.0**31 / draw)).astype(np.int64)
        moving = ahead < shards
    return at.astype(np.int32)


def shard_of(id_col: Column, shards: int, seed: int) -> Column:
    """(shard, grown) of an id: its shard, and its shard when there is one more."""

    @F.pandas_udf("shard int, grown int")
    def place(h: pd.Series) -> pd.DataFrame:
        keys = mixed(h.to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": jump_hash(keys, shards), "grown": jump_hash(keys, shards + 1)})

    return place(F.xxhash64(F.lit(seed), id_col))


def shuffle_into_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, bucket_bytes: int = 16 << 20, buckets_a_shard: int = 4) -> DataFrame:
    """docs with the columns shard, slot, grown_shard and size in front, in shard and slot order within each bucket.

    Slots of a shard count from 0 without gaps. A shard has buckets_a_shard buckets, or more where a bucket would
    exceed bucket_bytes. The bucket of a record follows from its id and text, so rows that repeat an id spread over their shard. A bucket is
    put in order of id and text before it is shuffled, so reruns agree.

    Defined cases: no rows give no rows. A null id is a key like any other. Rows that repeat an id share a shard; rows
    that are equal in id and text share a bucket, are told apart by nothing, and take neighbouring draws. A column of docs that is named like
    one of the four new ones comes back with `_of_docs` at the end of its name.
    """
    size = (F.octet_length(text_or_empty(text_col)) + RECORD_BYTES).cast("long")
    spread = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_col), F.xxhash64(text_col)), F.lit(1 << 31))
    placed = docs.withColumns({"__place": shard_of(F.col(id_col), shards, seed), "__size": size, "__spread": spread})
    light = placed.select("__place.shard", "__spread", "__size")
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(buckets_a_shard, math.ceil(total / (shards * bucket_bytes)))
    counts = written(light.groupBy("shard", (F.col("__spread") % buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("rows")), "shard-buckets")
    start = F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("shard").alias("__s"), F.col("bucket").alias("__b"), start.alias("__start"))

    own = {"shard", "grown_shard", "slot", "size"}
    columns = {c: f"{c}_of_docs" if c in own else c for c in docs.columns}
    records = placed.select(
        F.col("__place.shard").alias("__shard"), (F.col("__spread") % buckets).alias("__bucket"), F.col("__place.grown").alias("grown_shard"), F.col("__size").alias("size"),
        *[F.col(c).alias(name) for c, name in columns.items()],
    )
    records = records.join(if_small(starts), (F.col("__shard") == F.col("__s")) & (F.col("__bucket") == F.col("__b"))).drop("__s", "__b")
    # twice as many partitions as buckets: few tasks get several of them, and none gets many
    records = records.repartition(max(2 * shards * buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "__shard", "__bucket")
    named = [T.StructField(name, docs.schema[c].dataType) for c, name in columns.items()]
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("grown_shard", T.IntegerType()), T.StructField("size", T.LongType()), *named])

    def fisher_yates(bucket: pa.Table) -> pa.Table:
        shard, number, first = (bucket.column(c)[0].as_py() for c in ("__shard", "__bucket", "__start"))
        bucket = bucket.sort_by([(columns[id_col], "ascending"), (columns[text_col], "ascending")])
        order = np.arange(bucket.num_rows)
        np.random.Generator(np.random.PCG64([seed, shard, number])).shuffle(order)
        bucket = bucket.take(pa.array(order))
        n = bucket.num_rows
        fixed = [pa.array(np.full(n, shard, np.int32)), pa.array(first + np.arange(n, dtype=np.int64)), bucket.column("grown_shard"), bucket.column("size")]
        return pa.table(fixed + [bucket.column(c) for c in columns.values()], names=schema.names)

    return records.groupBy("__shard", "__bucket").applyInArrow(fisher_yates, schema)


def write_shards(shuffled: DataFrame, folder: str) -> None:
    """A folder per shard. A bucket is written by one task, in slot order; files of a shard are read in slot order by sorting on it.

    Defined cases: no rows give a folder without shards. Spark's committer takes the files of one attempt of each task only.
    """
    shuffled.write.partitionBy("shard").parquet(folder)


def sharded(spark: SparkSession, docs: DataFrame, shards: int, **options) -> DataFrame:
    """Write the shards to the shared folder and read them back."""
    shuffled, folder = shuffle_into_shards(docs, shards, **options), new_folder(spark, "shards")
    write_shards(shuffled, folder)
    return spark.read.schema(shuffled.schema).parquet(folder)
