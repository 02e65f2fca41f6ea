"""What the operators of this subpackage share: the cluster's shared folder, size-checked joins and hashed words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts that count words: a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
SPLIT = re.compile(WORD)
#: Rows of a side that may be broadcast. Each broadcast here has at most a few dozen bytes a row.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or, where all run in one process, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that the driver and all executors share")
        root = getattr(spark.sparkContext, "_linewise_shared", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="linewise-shared-")
            spark.sparkContext._linewise_shared = root
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/linewise-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, at_once: int | None = None) -> DataFrame:
    """The rows of df as a table in the shared folder: lineage ends here, and a lost executor costs no recomputation.

    at_once: for rows of megabytes, the bytes of a row group, measured after each row. Otherwise the writer measures after 100 rows at first, and a task that
    reads such a group has all its rows in memory. A table is deleted by drop_written(), by the operator that wrote it where nothing it returns reads it, or with
    the folder.
    """
    return written_at(df, name, at_once)[0]


def written_at(df: DataFrame, name: str, at_once: int | None = None) -> tuple[DataFrame, str]:
    """As written(), with the table's folder, for tasks that read a table of bounded size whole."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**_row_groups(at_once) if at_once else {}).parquet(path)
    context = df.sparkSession.sparkContext
    context._linewise_written = [*getattr(context, "_linewise_written", []), path]
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _row_groups(size: int) -> dict[str, int]:
    return {"parquet.block.size": size, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}


def written_so_far(spark: SparkSession) -> int:
    return len(getattr(spark.sparkContext, "_linewise_written", []))


def drop_written(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Delete the tables that written() has made in this session, all or those from the since-th on; returns how many."""
    paths = getattr(spark.sparkContext, "_linewise_written", [])
    gone = paths[since:until]
    for path in gone:
        fs, at = file_system(path)
        fs.delete_dir(at)
    spark.sparkContext._linewise_written = [p for p in paths if p not in set(gone)]
    return len(gone)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and the path in it; works in tasks for any store that Arrow knows."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only if it was counted to have no more rows than the limit; df must be cheap to count."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def without(docs: DataFrame, dropped: DataFrame, repeated: DataFrame, id_col: str, content: Column) -> DataFrame:
    """docs without the rows named by dropped, and with one of the rows named by each row of repeated.

    dropped and repeated have rows (id, of_text), each once; of_text is what `content` says of a row of docs. A row is named by both, as an
    id may be null or repeated. Of several rows of one name that with the least hash of its columns stays.
    """
    names = lambda rows: rows.select(F.col("id").alias("__id"), F.col("of_text").alias("__of_text"))
    named = docs.withColumn("__content", content)
    same = named[id_col].eqNullSafe(F.col("__id")) & (F.col("__content") == F.col("__of_text"))
    left = named.join(names(dropped), same, "left_anti")
    if repeated.isEmpty():
        return left.drop("__content")
    same = left[id_col].eqNullSafe(F.col("__id")) & (F.col("__content") == F.col("__of_text"))
    many = left.join(names(repeated), same, "left_semi").groupBy(F.col(id_col).alias("__id"), "__content")
    one = many.agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.hash(*[F.col(f"`{c}`") for c in docs.columns if not docs.schema[c].dataType.simpleString().startswith("map")])).alias("__row"))
    return left.join(names(repeated), same, "left_anti").drop("__content").unionByName(one.select("__row.*"))


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


class WordHashes(dict):
    """word -> 64-bit hash. Holds at most `limit` words, then starts anew, so vocabularies of any size are safe."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class CharTable:
    """Which characters make words, and a random 64-bit value for each; for hashing the words of many texts without a step per word."""

    def __init__(self, in_word):
        self.in_word = in_word
        self.words = np.array([in_word(chr(i)) for i in range(1 << 16)])
        self.values = mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64))
        base = 0x9E3779B97F4A7C15 | 1
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))

    def hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in order, for each text the number of words up to its end). Equal words have equal hashes.

        A word's hash is the sum of its characters' values times powers of an odd number, from differences of one running sum.
        """
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(points):
            return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
        wide = points > 0xFFFF
        low = points.astype(np.uint16)
        inside = self.words[low]
        value = self.values[low]
        if wide.any():
            kinds = {int(c): self.in_word(chr(int(c))) for c in np.unique(points[wide])}
            inside[wide] = [kinds[c] for c in points[wide].tolist()]
            value[wide] = mixed(points[wide].astype(np.uint64) << np.uint64(20))
        change = np.diff(inside.astype(np.int8), prepend=0, append=0)
        first, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        power = np.full(len(points), self.base, np.uint64)
        power[0] = 1
        value *= np.multiply.accumulate(power)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
        back = np.full(len(points) + 1, self.inverse, np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        words = mixed((total[end] - total[first]) * back[first])
        limits = np.cumsum([len(t) + 1 for t in texts])
        return words, np.searchsorted(first, limits)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of all runs of n consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    base, value = np.uint64(0x100000001B3 + 2 * seed), np.zeros(m, np.uint64)
    for j in range(n):
        value *= base
        value += words[j : j + m]
    return mixed(value)


def slices(batches: Iterable[pa.RecordBatch], column: str, budget: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about `budget` bytes, or one row if that alone has more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // budget
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)
