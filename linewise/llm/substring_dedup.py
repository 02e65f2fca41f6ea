"""Substring dedup with super-k-mers.

A window is a run of 20 words. Its minimiser is the smallest hash among its three-word runs. Consecutive windows of a text share a
minimiser for about ten windows, and travel together as one packed string, a super-k-mer, to the bucket of that minimiser.
Equal windows have equal minimisers, so each bucket finds its repeats alone: it sorts its windows and keeps the first of equal ones.

A minimiser of very common words would make a bucket too large for a task. A part of the texts tells how full buckets will be, and the
super-k-mers of full ones are divided by the second smallest hash of their windows, which equal windows share too. That changes where
windows meet, never whether.

What a task already knows is settled before the shuffle: of equal super-k-mers in a chunk of texts only the first travels, as
the others start later and are removed whatever other chunks hold. A passage in a third of all texts thus reaches its
bucket once for each chunk, not once for each text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPLIT, WordHashes, gram_hashes, slices, text_or_empty, written

WINDOW, MINIMISER = 20, 3
#: One text in so many is looked at to find full buckets; a bucket is full beyond so many times the mean, and so many words in those texts.
LOOKED_AT, FULL, LEAST_WORDS = 64, 4, 1000
_NO_ID = -(1 << 63)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, by doubling."""
    span, low = 1, values
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def super_kmers(hashes: np.ndarray, window: int = WINDOW, k: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, number of windows) of the runs of windows that share a minimiser."""
    if len(hashes) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    least = sliding_min(gram_hashes(hashes, k), window - k + 1)
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    return least[first], first, np.diff(np.append(first, len(least)))


def divided(hashes: np.ndarray, first: int, count: int, window: int = WINDOW, k: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(second minimiser, first window, number of windows) of the runs within a super-k-mer whose windows share their second smallest hash too."""
    grams = np.lib.stride_tricks.sliding_window_view(gram_hashes(hashes[first : first + count + window - 1], k), window - k + 1)
    second = np.where(grams == grams.min(axis=1, keepdims=True), np.uint64((1 << 64) - 1), grams).min(axis=1)
    at = np.concatenate(([0], np.flatnonzero(second[1:] != second[:-1]) + 1))
    return second[at], first + at, np.diff(np.append(at, len(second)))


def _pack(ids: list[int], starts: list[int], strings: list[str], of_texts: list[int] | None = None) -> bytes:
    """A compressed block of super-k-mers: their texts' ids and hashes, their first windows, and their words, a line each."""
    text = "\n".join(strings).encode("utf-8", "surrogatepass")
    numbers = np.array([ids, of_texts or [0] * len(ids), starts], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(ids)], "<i8").tobytes() + numbers + text)


class _Numbers(dict):
    """word -> its number, in order of first sight."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


def _unpack(blob: bytes) -> tuple[np.ndarray, str]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    return np.frombuffer(raw, "<i8", 3 * n, 8).reshape(3, n), raw[8 + 24 * n :].decode("utf-8", "surrogatepass")


class Chunk:
    """Super-k-mers of some texts: the first of equal ones by bucket, and the ranges of words that later ones cover."""

    def __init__(self, buckets: int, window: int, full: dict[int, int] | None = None):
        self.buckets, self.window, self.full = buckets, window, full or {}
        self.first: dict[str, tuple[int, int, int, int]] = {}
        self.later: list[tuple[int, int, int, int]] = []
        self.bytes = 0

    def add(self, doc: int, of_text: int, words: list[str], hashes: np.ndarray) -> None:
        least, first, count = super_kmers(hashes, self.window)
        bucket = (least % np.uint64(self.buckets)).tolist()
        runs = list(zip(bucket, first.tolist(), count.tolist(), strict=True))
        if self.full and not self.full.keys().isdisjoint(bucket):
            runs = [run for whole in runs for run in self.parts(hashes, *whole)]
        for b, at, n in runs:
            string = " ".join(words[at : at + n + self.window - 1])
            own, other = (doc, of_text, at, b), self.first.get(string)
            if other is None or own < other:
                self.first[string] = own
                own, other = other, own
                self.bytes += len(string) if own is None else 0
            if own is not None and own[:3] != other[:3]:
                self.later.append((*own[:3], own[2] + n + self.window - 1))

    def parts(self, hashes: np.ndarray, bucket: int, first: int, count: int) -> list[tuple[int, int, int]]:
        """The (bucket, first window, number of windows) that a super-k-mer is divided into, if its bucket is full."""
        into = self.full.get(bucket)
        if not into:
            return [(bucket, first, count)]
        second, at, n = divided(hashes, first, count, self.window)
        return list(zip((bucket + self.buckets * (1 + second % np.uint64(into)).astype(np.int64)).tolist(), at.tolist(), n.tolist(), strict=True))

    def rows(self) -> pa.RecordBatch:
        """A row per bucket (bucket, packed)."""
        by_bucket: dict[int, tuple[list, list, list, list]] = {}
        for string, (doc, of_text, at, b) in self.first.items():
            ids, starts, strings, of_texts = by_bucket.setdefault(b, ([], [], [], []))
            ids.append(doc)
            starts.append(at)
            strings.append(string)
            of_texts.append(of_text)
        packed = {b: _pack(*x) for b, x in by_bucket.items()}
        return pa.RecordBatch.from_pydict({"bucket": pa.array(list(packed), pa.int64()), "packed": pa.array(list(packed.values()), pa.binary())})


RANGES = pa.schema([("id", pa.int64()), ("of_text", pa.int64()), ("first", pa.int64()), ("end", pa.int64())])


def repeats_of(blobs: Iterable[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, first word, end) of what named_repeats_of finds, where ids alone name texts."""
    doc, _, first, end = named_repeats_of(blobs, window)
    return doc, first, end


def named_repeats_of(blobs: Iterable[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, hash of the text, first word, end) of runs of windows in a bucket that are not the first of their words.

    Windows are compared by the numbers of their words in the bucket's own vocabulary: hashes only tell which windows need no
    comparison.
    """
    vocabulary = _Numbers()
    places, lengths, numbers = [], [], []
    for blob in blobs:
        own, text = _unpack(blob)
        places.append(own)
        lengths += [line.count(" ") + 1 for line in text.split("\n")]
        words = text.replace("\n", " ").split(" ")
        numbers.append(np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)))
    if not lengths:
        return (np.empty(0, np.int64),) * 4
    n_words = np.array(lengths)
    word = np.concatenate(numbers)
    del numbers
    base = np.cumsum(n_words) - n_words
    n_windows = n_words - window + 1
    owner = np.repeat(np.arange(len(n_words)), n_windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = base[owner] + within  # a window's first word among all words of the bucket
    ids, of_texts, starts = np.concatenate(places, axis=1)
    doc, of_text, start = ids[owner], of_texts[owner], starts[owner] + within
    h = gram_hashes(word.astype(np.uint64) + np.uint64(1), window, seed=1)[at]
    order = np.argsort(h)
    again = h[order[1:]] == h[order[:-1]]
    order = order[np.append(again, False) | np.insert(again, 0, False)]  # only windows that share their hash with another
    if len(order) == 0:
        return (np.empty(0, np.int64),) * 4
    h, doc, of_text, start, at, owner = h[order], doc[order], of_text[order], start[order], at[order], owner[order]
    words_of = [word[at + j] for j in range(window)]
    order = np.lexsort((start, of_text, doc, h))
    if not all((w[order[1:]] == w[order[:-1]])[h[order[1:]] == h[order[:-1]]].all() for w in words_of):
        order = np.lexsort((start, of_text, doc, *words_of))  # two different windows have one hash: sort by the words themselves
    doc, of_text, start, owner = doc[order], of_text[order], start[order], owner[order]
    equal = np.ones(len(order) - 1, bool)
    for w in words_of:
        equal &= w[order[1:]] == w[order[:-1]]
    group = np.ones(len(order), np.int64)
    group[1:][equal] = 0
    first = np.flatnonzero(group)[np.cumsum(group) - 1]
    late = (doc != doc[first]) | (of_text != of_text[first]) | (start != start[first])  # rows that repeat an id and a text share their places, neither is later
    doc, of_text, start, owner = doc[late], of_text[late], start[late], owner[late]
    order = np.lexsort((start, owner))
    doc, of_text, start, owner = doc[order], of_text[order], start[order], owner[order]
    if not len(doc):
        return doc, of_text, start, start
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)))
    last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    return doc[new], of_text[new], start[new], start[last] + window


def named_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, of_text): a row is named by its id and, where the id is null or not the only one, by a hash of its text too; of_text is 0 elsewhere."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    again = rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id", F.lit(True).alias("again"))
    few = again.limit(BROADCAST_ROWS + 1).collect()
    if len(few) > BROADCAST_ROWS:  # too many to send to every task: all rows are named by both
        return rows.withColumn("of_text", F.xxhash64("text"))
    named = F.col("id").isNull()
    if few:
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([tuple(r) for r in few], again.schema)), "id", "left")
        named |= F.col("again").isNotNull()
    return rows.select("id", "text", F.when(named, F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("of_text"))


def full_buckets(rows: DataFrame, buckets: int, window: int) -> dict[int, int]:
    """bucket -> the number of parts it is divided into, of the buckets that have over FULL times the mean load.

    Loads are those of one text in LOOKED_AT, a part that grows with the input. No result depends on them: the fullest 100,000 are enough to send.
    """

    def load(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            least, size = [], []
            for text in batch.column("text").to_pylist():
                own, _, count = super_kmers(hashes.of(SPLIT.findall(text)), window)
                least.append(own % np.uint64(buckets))
                size.append(count + window - 1)
            if least:
                bucket, at = np.unique(np.concatenate(least), return_inverse=True)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket.astype(np.int64)), "words": pa.array(np.bincount(at, np.concatenate(size), len(bucket)).astype(np.int64))})

    looked_at = rows.filter(F.pmod(F.xxhash64(F.lit("load"), "id", "of_text"), F.lit(LOOKED_AT)) == 0).select("text")
    loads = written(looked_at.mapInArrow(load, "bucket long, words long").groupBy("bucket").agg(F.sum("words").alias("words")), "substring-loads")
    mean = (loads.agg(F.sum("words")).first()[0] or 0) / buckets
    full = loads.filter(F.col("words") > F.lit(FULL * mean)).filter(F.col("words") > LEAST_WORDS).orderBy(F.desc("words"), "bucket").limit(100_000).collect()
    return {r.bucket: min(4096, math.ceil(r.words / mean)) for r in full}


def repeated_ranges(rows: DataFrame, window: int = WINDOW, bucket_bytes: int = 24 << 20, chunk_bytes: int = 8_000_000) -> DataFrame:
    """(id, of_text, first, end) ranges of words of named rows that are covered by windows whose words also start earlier; ranges may overlap.

    bucket_bytes is the packed text that a bucket should have: super-k-mers hold about three times the texts' words.
    """
    rows = rows.withColumn("id", F.coalesce("id", F.lit(_NO_ID)))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = rows.sparkSession
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(3 * total / bucket_bytes))

    full = spark.sparkContext.broadcast(full_buckets(rows, buckets, window))  # 100,000 pairs of numbers at most

    def scatter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, turn = WordHashes(), 0
        chunk, held = Chunk(buckets, window, full.value), 0

        def settled(later: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            """Ranges that need no bucket go to any: they pass through it."""
            nonlocal turn
            cuts = [later[a : a + 5000] for a in range(0, len(later), 5000)]
            packed = [b"R" + np.array(cut, "<i8").tobytes() for cut in cuts]
            turn += len(cuts)
            return pa.RecordBatch.from_pydict({"bucket": pa.array([hash((later[0], turn, i)) % buckets for i in range(len(cuts))], pa.int64()), "packed": pa.array(packed, pa.binary())})

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal chunk, held
            if chunk.first:
                yield chunk.rows()
            if chunk.later:
                yield settled(chunk.later)
            chunk, held = Chunk(buckets, window, full.value), 0

        for batch in slices(batches, "text"):
            for doc, of_text, text in zip(*(batch.column(c).to_pylist() for c in ("id", "of_text", "text")), strict=True):
                words = SPLIT.findall(text)
                if len(words) >= window:
                    chunk.add(doc, of_text, words, hashes.of(words))
                held += len(text)
                if held >= chunk_bytes:
                    yield from flush()
        yield from flush()

    def resolve(bucket: pa.Table) -> pa.Table:
        blobs = bucket.column("packed").to_pylist()
        passed = [np.frombuffer(b, "<i8", offset=1).reshape(-1, 4) for b in blobs if b[:1] == b"R"]
        found = np.stack(named_repeats_of((b for b in blobs if b[:1] != b"R"), window), axis=1)
        every = np.concatenate([found, *passed])
        return pa.table([every[:, i] for i in range(4)], schema=RANGES)

    # as many partitions as buckets: few tasks get several of them, and none gets many
    return rows.mapInArrow(scatter, "bucket long, packed binary").repartition(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").groupBy("bucket").applyInArrow(resolve, "id long, of_text long, first long, end long")


def kept_words(words: list[str], first: list[int], end: list[int]) -> list[str]:
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, end, -1)
    return [w for w, c in zip(words, np.cumsum(cover[:-1]).tolist(), strict=True) if not c]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_text.

    Words are runs of anything but ASCII blanks, unchanged. A word is removed if a window of 20 words that covers it
    starts earlier too: in a text of smaller id, or earlier in the same text. kept_text has the other words, one
    space between them.

    Defined cases: a null text has no words; texts of fewer words than a window keep all. No rows give no rows. A null id is
    smaller than any other. Rows that repeat an id and a text are judged alike; of rows that repeat an id, or have none, with different texts
    the one whose text has the smaller xxhash64 is earlier. A text full of one word keeps its first window.
    """
    rows = named_rows(docs, id_col, text_col)
    ranges = repeated_ranges(rows, window, **options)
    spans = ranges.groupBy(F.col("id").alias("of_id"), F.col("of_text").alias("named")).agg(F.collect_set(F.struct("first", "end")).alias("spans"))  # as long as the text at most
    rows = rows.join(spans, (F.coalesce("id", F.lit(_NO_ID)) == F.col("of_id")) & (F.col("of_text") == F.col("named")), "left")
    rows = rows.select("id", "text", F.col("spans.first").alias("first"), F.col("spans.end").alias("end"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            total, removed, kept = [], [], []
            for text, first, end in zip(*(batch.column(c).to_pylist() for c in ("text", "first", "end")), strict=True):
                words = SPLIT.findall(text)
                left = kept_words(words, [min(x, len(words)) for x in first], [min(x, len(words)) for x in end]) if first else words
                total.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    return rows.mapInArrow(cut, "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


def digests(deduped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return deduped.select(id_col, "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
