"""Benchmark decontamination with SimHash over item-sized windows.

A benchmark item of n words is held against every run of n words of a document. Windows that share a shingle (a run of five words) with any
item get a 256-bit SimHash of their shingles; all others have nothing in common with an item. Fingerprints meet over four blocks of 64
bits (multi-index Hamming): if two differ in at most `radius` bits, some block differs in at most radius // 4, which one in some 2,000
pairs of unlike windows does. What lies within the radius is then verified by the exact similarity of the weighted shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CharTable, gram_hashes, mixed, slices, text_or_empty

SHINGLE, SIMILARITY = 5, 0.8
#: Bytes of text that are hashed at a time, and characters of a longer text: arrays of it have some 40 bytes a character.
SLICE = 1_000_000
BITS, BLOCK = 256, 64
#: Bits that fingerprints of windows at the similarity threshold may differ in. Two random +-1 projections of vectors with a
#: cosine of 2 x 0.8 / 1.8 differ with a chance of acos(0.889) / pi = 0.151: 38.6 of 256 bits on average, deviation 5.73. 71 bits lie
#: 5.6 deviations above; short items, whose sums are coarse, stay below it too (tests measure it).
RADIUS = 71
#: Windows that are fingerprinted at a time, and pairs of fingerprints that are compared at a time.
WINDOWS, PAIRS = 2048, 1_000_000


_table: list[CharTable] = []


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, lower-case runs of letters, digits and underscores, and the number of words up to the end of each text."""
    if not _table:
        _table.append(CharTable(lambda c: c.isalnum() or c == "_"))
    if all(len(t) <= SLICE for t in texts):
        return _table[0].hashes([t.lower() for t in texts])
    words, ends = [], []
    for text in texts:  # a text that is too long for one array is hashed in parts that end where a word does
        parts = [_table[0].hashes([part])[0] for part in whole_words(text.lower(), SLICE)]
        words += parts
        ends.append(sum(map(len, parts)))
    return np.concatenate(words), np.cumsum(ends)


def whole_words(text: str, size: int) -> Iterator[str]:
    """The text in parts of at least `size` characters that cut no word."""
    at = 0
    while at < len(text) or not at:
        end = at + size
        while end < len(text) and (text[end] == "_" or text[end].isalnum()):
            end += 1
        yield text[at:end]
        at = end


def bit_rows(shingles: np.ndarray) -> np.ndarray:
    """256 pseudo-random bits of each 64-bit shingle hash, as rows of 0 and 1."""
    seeds = [np.uint64(0xA5A5A5A5A5A5A5A5 * k & (1 << 64) - 1) for k in range(BITS // 64)]
    return np.unpackbits(np.stack([mixed(shingles ^ seed) for seed in seeds], axis=1).view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)


def fingerprints(ones: np.ndarray, weight: int) -> np.ndarray:
    """SimHashes, a row of four 64-bit blocks each, from the weighted number of ones of each bit; a bit is 1 where ones are more than half of the weight."""
    return np.packbits(2 * ones.astype(np.int32) > weight, axis=1).view(np.uint64)


def weighted_similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Jaccard similarity of shingles weighted by how often they occur."""
    common = sum(min(n, b[k]) for k, n in a.items() if k in b)
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 1.0


def counted(values: np.ndarray) -> dict[int, int]:
    keys, counts = np.unique(values, return_counts=True)
    return dict(zip(keys.tolist(), counts.tolist(), strict=True))


class ItemIndex:
    """Items of a benchmark by length in words, with their SimHashes in multi-index blocks."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS):
        self.radius = radius
        self.by_length: dict[int, list[int]] = {}
        self.ids, self.weights, prints = [], [], []
        for item, text in items:
            words = word_hashes([text])[0]
            if not len(words):
                continue
            shingles = self.shingles(words)
            self.by_length.setdefault(len(words), []).append(len(self.ids))
            self.ids.append(item)
            self.weights.append(counted(shingles))
            prints.append(fingerprints(bit_rows(shingles).sum(axis=0, keepdims=True), len(shingles))[0])
        self.prints = np.array(prints, np.uint64).reshape(len(prints), BITS // BLOCK)
        self.known = {w: self._known(w) for w in {min(SHINGLE, n) for n in self.by_length}}
        self.table = {w: np.zeros(1 << 20, bool) for w in self.known}
        for w, known in self.known.items():
            self.table[w][known >> np.uint64(44)] = True
        self.by_length = {n: np.array(own) for n, own in self.by_length.items()}

    @staticmethod
    def shingles(words: np.ndarray) -> np.ndarray:
        """Hashes of all five-word runs; texts of fewer words have one shingle, all their words."""
        return gram_hashes(words, min(SHINGLE, len(words)))

    def candidates(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, items) of fingerprints that meet an item of this length in some block and lie within the radius of it."""
        own, reach, found = self.by_length[length], self.radius // (BITS // BLOCK), []
        for a in range(0, len(own), PAIRS // WINDOWS):
            part = own[a : a + PAIRS // WINDOWS]
            met = np.zeros((len(prints), len(part)), bool)
            for k in range(BITS // BLOCK):
                met |= np.bitwise_count(prints[:, k, None] ^ self.prints[None, part, k]) <= reach
            rows, items = np.nonzero(met)
            near = np.bitwise_count(prints[rows] ^ self.prints[part[items]]).sum(axis=1, dtype=np.int64) <= self.radius
            found.append((rows[near], part[items[near]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def matches(self, text: str) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window for each item that the text contains."""
        return self.in_words(word_hashes([text])[0])

    def in_words(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        best: dict[int, tuple[float, int, int]] = {}
        for width in sorted(self.known):
            if len(words) < width:
                continue
            grams = gram_hashes(words, width)
            hit = np.concatenate(([0], np.cumsum(self.hits(grams, width))))
            lengths = [n for n in self.by_length if min(SHINGLE, n) == width and n <= len(words)]
            if not lengths or not hit[-1]:
                continue
            most = max(lengths) - width + 1
            near = hit[np.minimum(np.arange(len(grams)) + most, len(grams))] > hit[:-1]  # starts of windows that may hold a shingle of an item
            starts = np.flatnonzero(near)
            for low in self.stretches(starts):
                high = min(len(grams), low + WINDOWS + most)
                ones = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(bit_rows(grams[low:high]), axis=0, dtype=np.int32)))
                for length in lengths:
                    weight = length - width + 1
                    own = np.arange(low, min(low + WINDOWS, len(grams) - weight + 1))
                    own = own[hit[own + weight] > hit[own]]
                    if len(own):
                        prints = fingerprints(ones[own - low + weight] - ones[own - low], weight)
                        self._verify(grams, own, length, weight, prints, best)
        return [(self.ids[i], at, n, s) for i, (s, at, n) in sorted(best.items())]

    @staticmethod
    def stretches(starts: np.ndarray) -> Iterator[int]:
        """First places of stretches of WINDOWS places that have all the starts."""
        at = 0
        while at < len(starts):
            yield int(starts[at])
            at = int(np.searchsorted(starts, starts[at] + WINDOWS))

    def _verify(self, grams: np.ndarray, starts: np.ndarray, length: int, weight: int, prints: np.ndarray, best: dict) -> None:
        """Note the best window of each item among those whose fingerprints meet the item's."""
        counts: dict[int, dict[int, int]] = {}
        for row, item in zip(*(x.tolist() for x in self.candidates(length, prints)), strict=True):
            at = int(starts[row])
            if row not in counts:
                counts[row] = counted(grams[at : at + weight])
            s = weighted_similarity(counts[row], self.weights[item])
            if s >= SIMILARITY and (item not in best or (s, -at) > (best[item][0], -best[item][1])):
                best[item] = (s, at, length)

    def _known(self, width: int) -> np.ndarray:
        """All shingles of items of `width` words: SHINGLE, or the whole of a shorter item."""
        own = [np.array(list(self.weights[i]), np.uint64) for n, items in self.by_length.items() if min(SHINGLE, n) == width for i in items]
        return np.unique(np.concatenate(own))

    def hits(self, grams: np.ndarray, width: int) -> np.ndarray:
        """Which of the hashes are shingles of items."""
        found = self.table[width][grams >> np.uint64(44)]
        at = np.flatnonzero(found)
        found[at] = np.isin(grams[at], self.known[width])
        return found

    def in_texts(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
        """(number of the text, its matches) of the texts that have some; texts without a shingle of an item cost one pass."""
        words, ends = word_hashes(texts)
        touched: set[int] = set()
        for width in self.known:
            starts = np.flatnonzero(self.hits(gram_hashes(words, width), width))
            touched.update(np.searchsorted(ends, starts, "right").tolist())  # a run over the end of a text is sorted out below
        for i in sorted(touched):
            if found := self.in_words(words[ends[i - 1] if i else 0 : ends[i]]):
                yield i, found


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", items_a_block: int = 5000, block_bytes: int = 8 << 20) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded number and size; a benchmark is a stated set of queries, read block by block."""
    block, size = [], 0
    for item, text in benchmark.select(id_col, text_or_empty(text_col)).orderBy(id_col).toLocalIterator():
        block.append((item, text))
        size += len(text)
        if len(block) >= items_a_block or size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, **blocks) -> DataFrame:
    """A row per document row and item that it contains: id, item_id, first_word, n_words, similarity (of the best window).

    Words are lower-case runs of letters, digits and underscores. A window of as many words as the item is a match where the
    Jaccard similarity of their five-word shingles, weighted by occurrence, is 0.8 or more; items of fewer than
    five words have one shingle, and match whole.

    Defined cases: null and empty texts match nothing, items without words are matched by nothing; an empty table on either side gives no rows.
    A null id is returned as it is. Of equally similar windows the first is reported. Repeated rows are each reported.
    No text is shuffled; a benchmark beyond one block takes another pass for each block.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, item_id long, first_word long, n_words long, similarity double"
    rows, found = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), None
    for block in item_blocks(benchmark, **blocks):
        part = rows.mapInArrow(_matcher(block, radius, docs, id_col), schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def _matcher(block: list[tuple[int, str]], radius: int, docs: DataFrame, id_col: str):
    shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by item_blocks

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(shared.value, radius)
        for batch in slices(batches, "text", SLICE):
            out = [(i, *m) for i, found in index.in_texts(batch.column("text").to_pylist()) for m in found]
            if out:
                row, *rest = map(list, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), *(pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True))], names=[id_col, "item_id", "first_word", "n_words", "similarity"])

    return match


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", radius: int = RADIUS, **blocks) -> DataFrame:
    """docs without the rows that contain an item; all columns stay, nothing is shuffled."""
    for block in item_blocks(benchmark, **blocks):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, radius)
            for batch in slices(batches, text_col, SLICE):
                keep = np.ones(batch.num_rows, bool)
                keep[[i for i, _ in index.in_texts([t or "" for t in batch.column(text_col).to_pylist()])]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
