"""Near-duplicate detection with Order MinHash.

A text is the sequence of its five-word runs (k-mers), each labelled with how often it occurred before. A sketch takes the
few labelled k-mers with the least hash values and keeps them in the order of the text, so texts that share k-mers in another order do not
meet. Texts that share a sketch are candidates; a banded alignment of the two k-mer sequences decides.

Similarity of two texts: matched / (k-mers of both - matched), where matched is the length of the best alignment that keeps the order (0.8 or more
is a near duplicate). For texts without reordered passages that is the Jaccard similarity of their five-word shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPLIT, WordHashes, drop_written, gram_hashes, if_small, mixed, slices, text_or_empty, without, written, written_so_far

K, SIMILARITY = 5, 0.8
#: Order MinHash takes `DRAWN` k-mers a sketch, `SKETCHES` sketches a text. At similarity 0.8 two texts share one sketch with a
#: chance of 0.8^3 = 0.51, and none of 20 with 6e-7; at 0.3 the chance to share any is 0.42, and the alignment refuses.
DRAWN, SKETCHES = 3, 20
#: Sketches whose buckets are looked at first. The other buckets matter only where these leave them in several components.
FIRST = 6
#: Members of a bucket that meet in one piece of work; larger buckets are cut into blocks, and each two blocks meet.
BLOCK = 512
#: Candidates a member that a block may give at once. A block with more gives the nearest of them, and the rest once these are linked.
AT_ONCE = 8
_MULTIPLIERS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)


def words_of(text: str) -> list[str]:
    """Lower-case runs of anything but ASCII blanks."""
    return SPLIT.findall(text.lower())


def kmers(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word runs; a shorter text is one k-mer."""
    return gram_hashes(words, min(K, len(words))) if len(words) else np.empty(0, np.uint64)


def labelled(hashes: np.ndarray) -> np.ndarray:
    """k-mers with their occurrence number mixed in, so that all are different."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    first = np.flatnonzero(new)
    if len(first) == len(hashes):
        return hashes
    nth = np.empty(len(hashes), np.uint64)
    nth[order] = np.arange(len(hashes)) - first[np.cumsum(new) - 1]
    return np.where(nth > 0, mixed(hashes + nth * np.uint64(0x9E3779B97F4A7C15)), hashes)


def sketches(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit value per sketch. Texts of fewer k-mers than a sketch draws use all of them."""
    own = labelled(hashes)
    drawn = min(DRAWN, len(own))
    out = np.empty(SKETCHES, np.uint64)
    for s in range(SKETCHES):
        value = own * _MULTIPLIERS[s]
        value ^= value >> np.uint64(32)
        least = np.argpartition(value, drawn - 1)[:drawn] if len(own) > drawn else np.arange(drawn)
        least.sort()  # the order of the text
        kept = np.uint64(s + 1)
        for i in least:
            kept = mixed((kept + own[i : i + 1]) * np.uint64(0x100000001B3))
        out[s] = kept[0]
    return out


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each of at least 2 x k-mers cells (a power of two, 131072 at most): whether its number of labelled k-mers is odd.

    Two texts differ in at least as many k-mers as bits, so texts whose bits differ in more places than near duplicates may are none.
    """
    cells = 1 << min(17, max(8, (2 * len(hashes) - 1).bit_length()))
    odd = np.bincount((labelled(hashes) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence of a and b if it is `least` or more, else some smaller number.

    An alignment with `least` matches leaves len(a) + len(b) - 2 x least elements unmatched, so its path stays that near the
    diagonal: only this band is computed and held, a row at a time, with its cells as the bits of one integer.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n :] == b[len(b) - n :]
    tail = n if same.all() else int(same[::-1].argmin())
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    a, b = a[np.isin(a, b)], b[np.isin(b, a)]
    found = head + tail
    if len(a) == len(b) and (a == b).all():
        return found + len(a)
    need = least - found
    band = len(a) + len(b) - 2 * max(0, need)
    if band < 0 or min(len(a), len(b)) < need:
        return found
    places: dict[int, list[int] | int] = {}
    for i, x in enumerate(a.tolist()):
        places.setdefault(x, []).append(i)
    for x, at in places.items():
        if len(at) > 8:  # as one integer with a bit for each place
            places[x] = int.from_bytes(np.packbits(np.bincount(at, minlength=len(a)).astype(bool), bitorder="little").tobytes(), "little")
    # bit i - low of `row` is 0 where the alignment of a[: i + 1] with b[: j + 1] has one match more than that of a[:i]. Below the band nothing
    # changes any more: those bits are counted and dropped. Above it all bits are still 1, and are added when the band gets there.
    row = low = high = dropped = 0
    for j, x in enumerate(b.tolist()):
        if j - band > low:
            dropped += row & 1 ^ 1
            row >>= 1
            low += 1
        if (top := min(len(a), j + band + 1)) > high:
            row |= (1 << top - high) - 1 << high - low
            high = top
        at = places[x]
        if isinstance(at, list):
            m = sum(1 << i - low for i in at if low <= i < high)
        else:
            m = at >> low & (1 << high - low) - 1
        if met := row & m:
            row = ((row + met) | (row - met)) & (1 << high - low) - 1
    return found + dropped + high - low - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """The similarity of two k-mer sequences; below the threshold some smaller number."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    least = int(np.ceil(threshold * total / (1 + threshold) - 1e-9))
    if min(len(a), len(b)) < least:
        return 0.0
    matched = aligned(a, b, least)
    return matched / (total - matched)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def sketch_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, of_text, node, keys, n, odd): the id of each row, hashes of its text and of its words, its sketches, number of k-mers and parities.

    Equal sequences of words are one node.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("of_text", F.xxhash64("text"))

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            nodes, keys, numbers, odd = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = hashes.of(words_of(text))
                own = kmers(words)
                nodes.append(xxhash.xxh3_64_intdigest(words.tobytes()) - (1 << 63))
                keys.append(_signed(sketches(own)) if len(own) else np.empty(0, np.int64))
                numbers.append(len(own))
                odd.append(parities(own) if len(own) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("of_text"), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(numbers, pa.int32()), pa.array(odd, pa.binary())], names=["id", "of_text", "node", "keys", "n", "odd"])

    return rows.mapInArrow(sketch, f"id {docs.schema[id_col].dataType.simpleString()}, of_text long, node long, keys array<long>, n int, odd binary")


def stars(members: DataFrame) -> DataFrame:
    """(a, b): each node of a bucket with the bucket's hub, from members (key, node, size, component), unless one component has both.

    The hub is the node whose buckets have most members in all: a text that others were copied from. Pairs number no more
    than members, however large a bucket is.
    """
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    best = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node", "component")).alias("hub"))
    # a key may have very many members: as a table of their own, hubs meet them in a join that adaptive execution can split
    hubs = written(best.select("key", F.col("hub.node").alias("hub"), F.col("hub.component").alias("of_hub")), "near-hubs")
    pairs = members.join(hubs, "key").filter("component <> of_hub")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def bucketed(rows: DataFrame, name: str) -> DataFrame:
    """rows (key, node, ...) with size, of the keys that more than one node has."""
    counts = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), f"{name}-sizes")
    return written(rows.join(counts, "key"), name)


def split_buckets(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(key, node, size, component): the members of buckets whose nodes are in more than one component."""
    named = members.join(linked, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("component"))
    split = written(named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key"), "near-split")
    return named.join(split, "key", "left_semi")


class Block:
    """Members of a bucket in order of their numbers of k-mers, with their parities by size of these."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]):
        rows = sorted(rows, key=lambda r: (len(r[3]), r[0]))
        self.node, self.component = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        self.n = np.array([r[2] for r in rows], np.int64)
        widths = [len(r[3]) for r in rows]
        self.parts = {}
        for width in sorted(set(widths)):
            first, end = widths.index(width), widths.index(width) + widths.count(width)
            self.parts[width] = first, np.frombuffer(b"".join(r[3] for r in rows[first:end]), np.uint64).reshape(end - first, -1)

    def near(self, other: Block, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, bits that differ) of all members of different components that may be similar; similar texts' parities differ by a factor of two at most in size."""
        found = []
        for width, (first_a, odd_a) in self.parts.items():
            for other_width in (width // 2, width, 2 * width):
                if other_width not in other.parts:
                    continue
                first_b, odd_b = other.parts[other_width]
                fold_a, fold_b = (x if x.shape[1] == min(odd_a.shape[1], odd_b.shape[1]) else x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :] for x in (odd_a, odd_b))
                step = max(1, 2_000_000 // fold_b.size)
                for at in range(0, len(fold_a), step):
                    apart = np.bitwise_count(fold_a[at : at + step, None] ^ fold_b[None]).sum(axis=2, dtype=np.int64)
                    a, b = slice(first_a + at, first_a + at + len(apart)), slice(first_b, first_b + len(fold_b))
                    total = self.n[a][:, None] + other.n[b][None]
                    least = np.ceil(threshold * total / (1 + threshold) - 1e-9).astype(np.int64)
                    may = (apart <= total - 2 * least) & (np.minimum(self.n[a][:, None], other.n[b][None]) >= least) & (self.component[a][:, None] != other.component[b][None])
                    if other is self:
                        may &= self.node[a][:, None] < other.node[b][None]
                    i, j = np.nonzero(may)
                    found.append((self.node[a][i], other.node[b][j], apart[i, j]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def block_pairs(members: DataFrame, threshold: float, every: bool) -> DataFrame:
    """(a, b, more): all pairs of a bucket's members (key, node, size, component, n, odd) that may be similar and are in different components.

    Where a block has over AT_ONCE pairs a member it gives the nearest of each, and says so by `more`; with `every` it gives all.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key", "node"), blocks).cast("int")
    cut = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    cut = cut.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").select("key", "low", "high", "own", "node", "component", "n", "odd")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, out = None, [], []

        def met() -> None:
            low = Block([r[1:] for r in rows if r[0] == cell[1]])
            high = low if cell[1] == cell[2] else Block([r[1:] for r in rows if r[0] == cell[2]])
            a, b, apart = low.near(high, threshold)
            more = not every and len(a) > AT_ONCE * len(rows)
            if more:
                kept = []
                for side in (a, b):
                    order = np.lexsort((b, a, apart, side))
                    kept.append(order[np.concatenate(([True], side[order[1:]] != side[order[:-1]]))])
                kept = np.unique(np.concatenate(kept))
                a, b = a[kept], b[kept]
            if len(a):
                out.append((np.minimum(a, b), np.maximum(a, b), np.full(len(a), more)))

        def given() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "more"])

        for batch in batches:
            for key, low, high, *row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if (key, low, high) != cell:
                    if len(rows) > 1:
                        met()
                    cell, rows = (key, low, high), []
                    if len(out) >= 1000 or out and len(out[-1][0]) >= 10_000:
                        yield given()
                rows.append(tuple(row))
        if len(rows) > 1:
            met()
        if out:
            yield given()

    return cut.mapInArrow(meet, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar; texts has a row (node, text) for each node of a pair."""
    of_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = of_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        last, own = None, np.empty(0, np.uint64)
        for batch in slices(batches, "text_b"):
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            text_a, text_b = batch.column("text_a"), batch.column("text_b")
            good, score = [], []
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, own = a[i], kmers(hashes.of(words_of(text_a[i].as_py())))
                other = kmers(hashes.of(words_of(text_b[i].as_py())))
                if (s := similarity(own, other, threshold)) >= threshold:
                    good.append(i)
                    score.append(s)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64()), pa.array(score, pa.float64())], names=["a", "b", "similarity"])

    return both.mapInArrow(verify, "a long, b long, similarity double")


def components(edges: DataFrame, name: str = "near-components") -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) is connected to.

    Large stars and small stars in turn: each round links all larger neighbours of a node, then all smaller ones, to the
    smallest of them; the number of rounds grows with the logarithm of the longest path. A round is written before the next.
    """
    current, before = edges.select("a", "b"), None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.n).filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = large.join(least, large.u == least.n)
        small = small.select(F.col("v").alias("b"), F.col("m").alias("a")).union(small.select(F.col("u").alias("b"), F.col("m").alias("a"))).filter("a <> b").distinct()
        current = written(small.select("a", "b"), name)
        state = current.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            return current.select(F.col("b").alias("node"), F.col("a").alias("component")).union(current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        before = state


def grown(linked: DataFrame, edges: DataFrame) -> DataFrame:
    """The components of linked (node, component) and further edges together."""
    if edges.isEmpty():
        return linked
    return components(linked.select(F.col("component").alias("a"), F.col("node").alias("b")).filter("a <> b").union(edges))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: id, class_id (the smallest id of its class), class_size and kept (whether it is that row's class).

    A class is a set of texts connected by pairs of similarity `threshold` or more. Equal sequences of words are one text from the start.
    Texts of a bucket are held against its hub: first in the buckets of a few sketches, then in those of all sketches that
    still have several classes. Hubs only save work: in the end all texts of a bucket that are still of different classes are compared,
    however many these are, unless their parities already show that they differ in too many k-mers.

    Defined cases: no rows give no rows. Null and empty texts have no words and are one class. A text of under five words is one k-mer, and
    is near only to equal ones. A null id counts as larger than all others. Of rows that repeat the smallest id all are kept.
    """
    labels = classified(docs, id_col, text_col, threshold)
    classes = labels.groupBy("component").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    # a class may hold a third of all rows: as a table of its own it is broadcast, or else adaptive execution can split the join's exchanges
    rows = labels.join(if_small(written(classes, "near-classes")), "component", "left")
    class_id = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("least"))
    return rows.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.coalesce("size", F.lit(1).cast("long")).alias("class_size"), F.col("id").eqNullSafe(class_id).alias("kept"))


def classified(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """(id, of_text, component): the class of each row of docs, with the hash of its text. Tables made on the way are deleted."""
    since = written_so_far(docs.sparkSession)
    sketched = written(sketch_texts(docs, id_col, text_col), "near-sketches")
    nodes = sketched.groupBy("node").agg(F.first("keys").alias("keys"), F.first("n").alias("n"), F.first("odd").alias("odd"), F.min(F.struct("id", "of_text")).alias("carrier"))
    nodes = written(nodes, "near-nodes")
    members = bucketed(nodes.select("node", F.posexplode("keys").alias("nth", "key")), "near-members")
    pairs = written(stars(members.filter(F.col("nth") < FIRST).withColumn("component", F.col("node"))), "near-pairs")

    carriers = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("carrier.id").alias("carrier"), F.col("carrier.of_text").alias("carried"))
    carriers = if_small(written(carriers, "near-carriers"))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("of_text", F.xxhash64("text"))
    texts = rows.join(carriers, (F.col("of_text") == F.col("carried")) & F.col("id").eqNullSafe(F.col("carrier"))).select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "near-texts")
    linked = components(written(verified(pairs, texts, threshold).select("a", "b"), "near-edges"))

    open_members = written(split_buckets(members, linked), "near-open")
    more = written(stars(open_members).join(pairs, ["a", "b"], "left_anti"), "near-more-pairs")
    linked = grown(linked, written(verified(more, texts, threshold).select("a", "b"), "near-more-edges"))

    # what hubs left apart: all pairs of different components in one bucket, the nearest first where these are many
    seen, every = pairs.union(more), False
    while True:
        still_open = split_buckets(open_members.drop("component"), linked).join(nodes.select("node", "n", "odd"), "node")
        close = written(block_pairs(still_open, threshold, every), "near-close")
        new = written(close.select("a", "b").join(seen, ["a", "b"], "left_anti"), "near-last-pairs")
        edges = written(verified(new, texts, threshold).select("a", "b"), "near-last-edges")
        linked, seen, every = grown(linked, edges), seen.union(new), edges.isEmpty()
        if close.filter("more").isEmpty():
            break

    # copies of a text may be a third of all rows: two tables meet in a join that adaptive execution can split
    moved = written(linked.filter("node <> component"), "near-moved")
    labels = sketched.select("id", "of_text", "node").join(moved, "node", "left").select("id", "of_text", F.coalesce("component", "node").alias("component"))
    labels = written(labels, "near-labels")
    drop_written(docs.sparkSession, since, -1)
    return labels


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class, the one with the smallest id; all columns stay.

    A row is named by its id and text, as an id may be null, which is larger than all others, or repeated: then the smaller hash of the text stays.

    Defined cases: no rows give no rows. Null and empty texts are one class, of which one row stays. Of rows that repeat the id and the text that
    stay, the one with the least hash of its columns stays.
    """
    labels = classified(docs, id_col, text_col, threshold)
    named = labels.groupBy("component", "id", "of_text").agg(F.count(F.lit(1)).alias("rows")).withColumn("place", F.struct(F.col("id").isNull().alias("none"), "id", "of_text"))
    named = written(named, "near-places")
    first = named.groupBy("component").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("places")).filter("places > 1")
    kept = F.col("first").isNull() | (F.col("place") == F.col("first"))
    named = written(named.join(if_small(written(first, "near-first")), "component", "left").select("id", "of_text", "rows", kept.alias("kept")), "near-named")
    return without(docs, named.filter("not kept"), named.filter("kept and rows > 1"), id_col, F.xxhash64(text_or_empty(text_col)))
