"""Documents joined by the Jaccard similarity of their shingles, with a grouped prefix join.

Shingles have one order for all documents: those that were met repeatedly come last, by how often. Two sets that are similar enough share one of their first
shingles, their prefixes (any order is right; rare shingles first keep buckets small). Equal sets are one node, nodes of equal prefix and size one group. Groups meet in
the buckets of their prefixes' shingles, and a pair stays only where sizes and the places of the shared shingle allow enough others; it is then expanded to its members.
In buckets of over `FEW` nodes each group meets the bucket's hub, and then, where several components are left, all members of different components meet in blocks.
Pairs are filtered by parities of their shingles; what is left is verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CharTable, drop_written, file_system, gram_hashes, if_small, slices, text_or_empty, written, written_at, written_so_far
from .near_dedup import block_pairs, bucketed, components, grown, parities, split_buckets, stars

WORDS, PERCENT = 3, 90
#: Shingles that tasks hold with a count at most. They only order shingles, so which are held changes no result.
HELD_SHINGLES = 1 << 20
#: Shingles that a task sorts together to find those that are repeated, and bytes of text that it cuts at once.
AT_ONCE = 2_000_000
TEXT_BYTES = 1_000_000
#: Nodes of a bucket whose groups all meet at once.
FEW = 64


class Words(CharTable):
    """Hashes of runs of anything but ASCII blanks, with A-Z as a-z."""

    def __init__(self):
        super().__init__(lambda c: c not in " \t\n\x0b\x0c\r")
        self.values[65:91] = self.values[97:123]


_words: list[Words] = []


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The different shingles of each text as sorted 64-bit hashes; a text of fewer words is one shingle, and one without words has none."""
    if not _words:
        _words.append(Words())
    hashes, ends = _words[0].hashes(texts)
    own, at = [], 0
    for end in ends.tolist():
        words, at = hashes[at:end], end
        own.append(np.unique(gram_hashes(words, min(size, len(words)))) if len(words) else np.empty(0, np.uint64))
    return own


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits as two signed numbers."""
    both = xxhash.xxh3_128_intdigest(values.tobytes())
    return (both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    """How many first shingles of a set of n hold one that any similar set has too: such a set shares at least percent n / 100 of them."""
    return n - -(-percent * n // 100) + 1 if n else 0


def ordered(values: np.ndarray, held: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles, those not held first, then by count."""
    if not len(held):
        return values
    at = np.minimum(np.searchsorted(held, values), len(held) - 1)
    return values[np.lexsort((values, np.where(held[at] == values, counts[at], 0)))]


def repeated_shingles(rows: DataFrame, size: int, most: int) -> str:
    """The folder of a table (shingle, n) of at most `most` rows: the shingles met repeatedly most often, counted where they were met together."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def repeated() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate((np.empty(0, np.uint64), *waiting)), return_counts=True)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["shingle", "n"])

        held = 0
        for batch in slices(batches, "text", TEXT_BYTES):
            own = shingle_sets(batch.column("text").to_pylist(), size)
            waiting += own
            held += sum(map(len, own))
            if held > AT_ONCE:
                yield repeated()
                held = 0
        yield repeated()

    counts = written(rows.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "join-shingles")
    held, least = 0, 1 << 62
    for row in counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count(F.lit(1)).alias("shingles"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        held += row.shingles
        if held > most:
            break
        least = row.least
    return written_at(counts.filter(F.col("n") >= least), "join-held")[1]


_held: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def held_shingles(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, counts) of that table; each worker process keeps those of one."""
    if path not in _held:
        _held.clear()
        fs, at = file_system(path)
        table = pads.dataset(at, filesystem=fs, format="parquet").to_table()
        keys = table.column("shingle").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        _held[path] = keys[order], table.column("n").to_numpy()[order]
    return _held[path]


def with_prefixes(rows: DataFrame, size: int, percent: int, path: str) -> DataFrame:
    """(id, of_text, n, d1, d2, p1, p2, prefix, odd): size, digest, prefix with its digest, and parities of each row's set."""
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = held_shingles(path)
        for batch in slices(batches, "text", TEXT_BYTES):
            found = []
            for own in shingle_sets(batch.column("text").to_pylist(), size):
                prefix = ordered(own, *held)[: prefix_length(len(own), percent)]
                found.append((len(own), *digest(own), *digest(prefix), prefix.view(np.int64), parities(own) if len(own) else b""))
            kinds = [pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64()), pa.binary()]
            columns = list(zip(*found, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("of_text"), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=["id", "of_text", "n", "d1", "d2", "p1", "p2", "prefix", "odd"])

    return rows.mapInArrow(cut, f"id {kind}, of_text long, n int, d1 long, d2 long, p1 long, p2 long, prefix array<long>, odd binary")


def met_in_small_buckets(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes that buckets (key, node, group, n, pos) of few nodes allow: groups are paired and filtered, then expanded to their members.

    At the first shingle that two sets share, at places i and j of their orders, they share no more than the lesser of n_a - i and n_b - j shingles.
    """
    rows = members.filter("node = group").select("key", "group", "n", "pos")
    a, b = (rows.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("group", "n", "pos"))) for x in "ab")
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    places = (100 + percent) * F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= percent * (F.col("n_a") + F.col("n_b"))
    met = a.join(b, (a.key == b.key) & (F.col("group_a") < F.col("group_b")) & sizes & places).select("group_a", "group_b").distinct()
    large = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("nodes")).filter("nodes > 1").join(members.select("group").distinct(), "group", "left_semi")
    several = written(nodes.select("group", "node").join(large, "group", "left_semi"), "join-several")
    of = lambda x: several.select(F.col("group").alias(f"group_{x}"), F.col("node").alias(f"node_{x}"))
    expanded = met.join(of("a"), "group_a", "left").join(of("b"), "group_b", "left").select(F.coalesce("node_a", "group_a").alias("x"), F.coalesce("node_b", "group_b").alias("y"))
    within = of("a").join(of("b"), (F.col("group_a") == F.col("group_b")) & (F.col("node_a") < F.col("node_b"))).select(F.col("node_a").alias("x"), F.col("node_b").alias("y"))
    return expanded.union(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def may_link(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and parities allow that they are similar."""
    own = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n_a, n_b, odd_a, odd_b in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "odd_a", "odd_b")), strict=True):
                a, b = sorted((np.frombuffer(odd_a, np.uint64), np.frombuffer(odd_b, np.uint64)), key=len)
                while len(b) > len(a):  # cells are powers of two: a half folds onto the other
                    b = b[: len(b) // 2] ^ b[len(b) // 2 :]
                good.append(int(np.bitwise_count(a ^ b).sum()) <= n_a + n_b - 2 * least_shared(n_a + n_b, percent))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    return both.mapInArrow(keep, "a long, b long")


def least_shared(total: int, percent: int) -> int:
    """How many shingles two sets of `total` together must share: 100 shared >= percent (total - shared)."""
    return -(-percent * total // (100 + percent))


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. The sets are cut anew from the texts of the nodes' carriers, and must have the nodes' digests."""
    ends = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "join-ends")
    wanted = if_small(written(ends.join(nodes, "node").select("node", F.col("carrier.id").alias("of_id"), F.col("carrier.of_text").alias("of"), "d1", "d2"), "join-carriers"))
    texts = rows.join(wanted, (F.col("of_text") == F.col("of")) & F.col("id").eqNullSafe(F.col("of_id"))).select("node", "d1", "d2", "text")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT_BYTES):
            own = shingle_sets(batch.column("text").to_pylist(), size)
            same = [digest(x) == d for x, d in zip(own, zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), strict=True), strict=True)]
            nodes_of = batch.column("node").filter(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays([nodes_of, pa.array([x.tobytes() for x, good in zip(own, same, strict=True) if good], pa.binary())], names=["node", "own"])

    sets = written(texts.mapInArrow(cut, "node long, own binary").dropDuplicates(["node"]), "join-sets")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("of_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("own").alias("of_a")), "a")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                shared = len(a) + len(b) - len(np.union1d(a, b))
                good.append(shared >= least_shared(len(a) + len(b), percent))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    return both.select("a", "b", "of_a", "of_b").mapInArrow(verify, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id, n_shingles (different shingles of `size` words) and component_id.

    Two documents link when their shingles' Jaccard similarity is at least percent / 100; component_id is the smallest id that links lead to, the own one included.

    Defined cases: no rows give no rows. Null and empty texts and texts without words have no shingles and link with nothing, not with each other. Texts of fewer words than
    `size` link with texts of the same words. A null id counts as larger than all others. Rows that repeat an id are documents each. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    since = written_so_far(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("of_text", F.xxhash64("text"))
    sets = written(with_prefixes(rows, size, percent, repeated_shingles(rows.select("text"), size, HELD_SHINGLES)), "join-prefixes")

    # equal sets are one node, named by a number of its own; hot ones are aggregated within tasks first
    key = ("n", "d1", "d2")
    first = sets.filter("n > 0").groupBy(*key).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "of_text")).alias("carrier"), F.first("prefix").alias("prefix"), F.first("odd").alias("odd"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    nodes = written(first.withColumn("node", F.monotonically_increasing_id()), "join-nodes")
    groups = written(nodes.groupBy("n", "p1", "p2").agg(F.min("node").alias("group")), "join-groups")
    nodes = written(nodes.join(groups, ["n", "p1", "p2"]), "join-grouped")
    members = bucketed(nodes.select("node", "group", "n", F.posexplode("prefix").alias("pos", "key")), "join-members")
    few, many = members.filter(F.col("size") <= FEW), members.filter(F.col("size") > FEW)
    of_hubs = stars(many.filter("node = group").select("key", "node", "size", F.col("node").alias("component")))
    of_groups = nodes.filter("node <> group").select(F.col("group").alias("a"), F.col("node").alias("b"))
    light = written(nodes.select("node", "n", "odd"), "join-parities")
    pairs = written(may_link(met_in_small_buckets(few, nodes, percent).union(of_hubs).union(of_groups).distinct(), light, percent), "join-pairs")
    linked = components(written(verified(pairs, nodes, rows, size, percent), "join-links"), "join-components")

    seen, every = pairs, False
    while True:
        still_open = split_buckets(many.select("key", "node", "size"), linked).join(light, "node")
        close = written(block_pairs(still_open, percent / 100, every), "join-close")
        new = written(close.select("a", "b").join(seen, ["a", "b"], "left_anti"), "join-more-pairs")
        if new.isEmpty():
            edges = new
        else:
            edges = written(verified(new, nodes, rows, size, percent), "join-more-links")
        linked, seen, every = grown(linked, edges), seen.union(new), edges.isEmpty()
        if close.filter("more").isEmpty():
            break

    # a set may be that of a third of all rows: two tables meet in joins that adaptive execution can split
    moved = written(linked.filter("node <> component"), "join-moved")
    of_set = nodes.join(moved, "node", "left").select(*key, "carrier", F.coalesce("component", "node").alias("component"))
    of_set = written(of_set, "join-classes")
    least = of_set.groupBy("component").agg(F.min("carrier").alias("least"))
    of_set = written(of_set.join(least, "component").select(*key, F.col("least.id").alias("component_id")), "join-labels")
    labelled = sets.select("id", *key).join(of_set, list(key), "left")
    component: Column = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = written(labelled.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")), "join-rows")
    drop_written(spark, since, -1)
    return out
