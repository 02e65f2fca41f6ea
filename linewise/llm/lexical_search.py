"""Ranked lexical search by windowed bucket scoring over an index of whole texts.

The index cuts the documents into windows of consecutive places. It has a row per window and term, with the places of the documents that hold the term
and how often each does, and a row per window with its documents' ids and sizes. A search joins the terms of all items with the index, so only their rows move.
A task then takes one window after the other: for each item it goes through the postings of its terms in the window, adds their scores into an array with a
number per place, marks these places in a set of bits, and harvests the marked ones into the item's heap of best documents.

Scores are whole numbers (see `search`), so they do not depend on the order in which they are added.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import if_small, slices, written

#: Documents of a window: their scores take 64 KB, which a core's own cache holds.
WINDOW = 8192
#: Postings of a window at most; a window with more ends early.
POSTINGS = 2_000_000
#: Rows (item, term) of the items that a task scores together; more items make more blocks, in which the postings of their terms meet again.
BLOCK_TERMS = 50_000
#: A term is a run of ASCII letters and digits and of all characters beyond ASCII; in UTF-8 each byte says by itself whether it is part of one.
_PART = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Index(NamedTuple):
    """postings: (window, term, places, times), packed as unsigned 16- and 32-bit numbers; windows: (window, ids, sizes)."""

    postings: DataFrame
    windows: DataFrame


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all terms of the texts in order, how many each text has); only A-Z are lower-cased, a null text has none."""
    texts = texts.cast(pa.binary()) if pa.types.is_string(texts.type) else texts
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(texts.drop_null().to_pylist()), np.uint8)
    inside = _PART[raw]
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
    starts_of_texts = (np.cumsum(lengths) - lengths)[lengths > 0]
    before[starts_of_texts] = False  # a term ends with its text
    starts = np.flatnonzero(inside & ~before)
    kept = np.cumsum(inside) - inside  # bytes of terms before each byte
    offsets = np.append(kept[starts], int(inside.sum())).astype(np.int32)
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths)))))
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])]), counts


def counted_terms(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different terms, the term, text and count of each term and text that has it, terms of each text)."""
    terms, sizes = terms_of(texts)
    coded = terms.dictionary_encode()
    key = (coded.indices.to_numpy().astype(np.int64) << 32) | np.repeat(np.arange(len(sizes)), sizes)
    key, times = np.unique(key, return_counts=True)
    return coded.dictionary.to_pylist(), key >> 32, key & 0xFFFFFFFF, times, sizes


class WindowBuilder:
    """Collects the postings of one window."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: list = []
        self.sizes: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        terms, term, text, times, sizes = counted_terms(texts)
        number = np.fromiter((self.number.setdefault(x, len(self.number)) for x in terms), np.int64, len(terms))
        self.parts.append((number[term] if len(terms) else term, text + len(self.ids), times))
        self.ids += ids.to_pylist()
        self.sizes.append(sizes)
        self.held += len(term)

    def rows(self, window: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The row of the window, whose term is null, and those of its terms."""
        terms = list(self.number)
        term, place, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort((term << 32) | place)
        ends = np.cumsum(np.bincount(term, minlength=len(terms)))
        places = place[order].astype("<u2")
        times = times[order].astype("<u4")
        packed = lambda x: pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate(([0], ends * x.itemsize)).astype(np.int32)), pa.py_buffer(x)])
        names = ["window", "term", "places", "times", "ids", "sizes"]
        ids = pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), pa.array(self.ids, id_type))
        yield pa.RecordBatch.from_arrays([pa.array([window]), pa.array([None], pa.binary()), *[pa.array([None], pa.binary())] * 2, ids, pa.array([np.concatenate(self.sizes).astype("<i8").tobytes()], pa.binary())], names=names)
        for a in range(0, len(terms), 20_000):
            b = min(len(terms), a + 20_000)
            own = [x.slice(a, b - a) for x in (packed(places), packed(times))]
            yield pa.RecordBatch.from_arrays([pa.array([window] * (b - a), pa.int64()), pa.array(terms[a:b], pa.binary()), *own, pa.nulls(b - a, ids.type), pa.nulls(b - a, pa.binary())], names=names)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> Index:
    """The index of all documents, in tables of the shared folder; built where the documents are read, without a shuffle.

    Defined cases: no rows give an index of none. Null and empty texts, and those without terms, have a place and size 0. Rows that repeat an
    id, or have none, are documents each. Texts of any length are read whole.
    """
    if not 0 < window <= 1 << 16:
        raise ValueError("a window has 1 to 65536 documents")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, own, id_type = TaskContext.get().partitionId() << 32, WindowBuilder(), None
        for batch in slices(batches, "text"):
            id_type = batch.schema.field("id").type
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(window - len(own.ids), batch.num_rows - at))
                own.add(part.column("id"), part.column("text"))
                at += part.num_rows
                if len(own.ids) == window or own.held >= POSTINGS:
                    yield from own.rows(number, id_type)
                    number, own = number + 1, WindowBuilder()
        if own.ids:
            yield from own.rows(number, id_type)

    table = written(rows.mapInArrow(build, f"window long, term binary, places binary, times binary, ids array<{kind}>, sizes binary"), "search-index")
    return Index(table.filter("term is not null").select("window", "term", "places", "times"), table.filter("term is null").select("window", "ids", "sizes"))


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, id, term, repeats): the terms of all items. Rows that repeat an id and a text are one item."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).distinct()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            terms, term, text, times, _ = counted_terms(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(number + text), batch.column("id").take(pa.array(text)), pa.array([terms[i] for i in term], pa.binary()), pa.array(times)], names=["item", "id", "term", "repeats"])
            number += batch.num_rows

    return written(rows.mapInArrow(cut, f"item long, id {items.schema[id_col].dataType.simpleString()}, term binary, repeats long"), "search-items")


def search(index: Index, items: DataFrame, best: int = 20, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the `best` documents of highest score over 0, fewer if there are not as many.

    With N documents that have terms, L terms in all and n in a document, df documents with a term and tf of it in one: a term weighs
    w = floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + 25nN div L, and a document scores the sum of w (10^9 tf div (1000 tf + 12m)) over the item's terms, repeats included.
    Ranks are 1, 2, ...; equal scores rank by id, null last.

    Defined cases: items without terms, and an empty index, have no rows. Each different (id, text) is an item, so an id with two texts has two lists.
    """
    terms = item_terms(items, id_col, text_col)
    totals = index.windows.mapInArrow(_totals, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    n_docs, n_terms = totals.n or 0, totals.l or 0
    size = terms.count()
    blocks = max(1, -(-size // block_terms))
    sought = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))

    own = if_small(sought.select("term").distinct())
    met = index.postings.join(own, "term")
    df = met.groupBy("term").agg(F.sum(F.octet_length("places") / 2).cast("long").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weighed = written(sought.join(df, "term").withColumn("weight", weight).filter("weight > 0").select("block", "item", "term", (F.col("weight") * F.col("repeats")).alias("factor")), "search-terms")
    # one row per block and term, with all its items: a term of many items meets a posting once for each block
    wanted = weighed.groupBy("block", "term").agg(F.collect_list(F.struct("item", "factor")).alias("items"))
    wanted = if_small(written(wanted, "search-blocks"))
    hits = index.postings.join(wanted, "term").select("block", "window", "places", "times", "items", F.lit(None).cast("binary").alias("sizes"), F.lit(None).cast(index.windows.schema["ids"].dataType).alias("ids"))
    empty = F.lit(None).cast("binary")
    each = index.windows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    each = each.select("block", "window", empty.alias("places"), empty.alias("times"), F.lit(None).cast(wanted.schema["items"].dataType).alias("items"), "sizes", "ids")
    together = hits.unionByName(each).repartition("block", "window").sortWithinPartitions("block", "window", F.col("ids").isNull())

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, scorer = None, None
        for batch in batches:
            columns = [batch.column(c) for c in ("block", "window", "places", "times", "sizes", "ids", "items")]
            keys = list(zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True))
            for k, key in enumerate(keys):
                if key != at:
                    if scorer:
                        scorer.harvest()
                        if key[0] != at[0]:
                            yield scorer.best_rows(batch.schema.field("ids").type.value_type)
                    if not scorer or key[0] != at[0]:
                        scorer = Scorer(best, n_docs, n_terms)
                    at = key
                    scorer.open(np.frombuffer(columns[4][k].as_py(), "<i8"), columns[5][k].values)
                else:
                    own = columns[6][k].values
                    scorer.postings(np.frombuffer(columns[2][k].as_py(), "<u2"), np.frombuffer(columns[3][k].as_py(), "<u4"), own.field("item").to_numpy(), own.field("factor").to_numpy())
        if scorer:
            scorer.harvest()
            yield scorer.best_rows(batch.schema.field("ids").type.value_type)

    found = together.mapInArrow(score, f"item long, doc_id {index.windows.schema['ids'].dataType.elementType.simpleString()}, score long")
    # each task has the best of its windows: they meet in two steps, so that no task gets those of all tasks
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["item", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))], ["item"]):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= best)
    named = terms.select("item", "id").distinct()
    return found.join(if_small(named), "item").select(F.col("id").alias(id_col), "rank", "doc_id", "score")


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = total = 0
    for batch in batches:
        for own in batch.column("sizes").to_pylist():
            sizes = np.frombuffer(own, "<i8")
            n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "l": pa.array([total], pa.int64())})


class Scorer:
    """Scores one window after the other and holds each item's best documents so far."""

    def __init__(self, best: int, n_docs: int, n_terms: int):
        self.best, self.n_docs, self.n_terms = best, n_docs, max(1, n_terms)
        self.heaps: dict[int, list] = defaultdict(list)

    def open(self, sizes: np.ndarray, ids: pa.Array) -> None:
        """Begin a window."""
        self.length = 12 * (75 + 25 * sizes * self.n_docs // self.n_terms)
        self.ids = ids
        self.waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        self.scores, self.marked = np.zeros(len(sizes), np.int64), np.zeros(-(-len(sizes) // 8), np.uint8)

    def postings(self, places: np.ndarray, times: np.ndarray, items: np.ndarray, factors: np.ndarray) -> None:
        """The postings of one term, and the items that seek it."""
        for item, factor in zip(items.tolist(), factors.tolist(), strict=True):
            self.waiting[item].append((len(self.lists), factor))
        times = times.astype(np.int64)
        self.lists.append((places, 1_000_000_000 * times // (1000 * times + self.length[places])))

    def harvest(self) -> None:
        """Score every item over the window's postings and take its best documents."""
        for item, lists in self.waiting.items():
            for k, factor in lists:
                places, values = self.lists[k]
                self.scores[places] += factor * values  # a term has a place once
                np.bitwise_or.at(self.marked, places >> 3, (1 << (places & 7)).astype(np.uint8))
            at = np.flatnonzero(np.unpackbits(self.marked, count=len(self.scores), bitorder="little"))
            own = self.scores[at]
            heap = self.heaps[item]
            least = heap[0][0] if len(heap) == self.best else 1
            if len(at) > self.best:
                least = max(least, int(np.partition(own, len(own) - self.best)[len(own) - self.best]))
            for k in np.flatnonzero(own >= least).tolist():
                self._offer(heap, int(own[k]), self.ids[int(at[k])].as_py())
            self.scores[at], self.marked[:] = 0, 0
        self.waiting, self.lists = defaultdict(list), []

    def _offer(self, heap: list, score: int, doc) -> None:
        entry = (score, _Later(doc))
        if len(heap) < self.best:
            heapq.heappush(heap, entry)
        elif heap[0] < entry:
            heapq.heapreplace(heap, entry)

    def best_rows(self, id_type: pa.DataType) -> pa.RecordBatch:
        rows = [(item, doc.id, score) for item, heap in self.heaps.items() for score, doc in heap]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], id_type), pa.array(columns[2], pa.int64())], names=["item", "doc_id", "score"])


class _Later:
    """Orders ids so that a smaller one is better, and null the worst."""

    __slots__ = ("id",)

    def __init__(self, id):
        self.id = id

    def __lt__(self, other: _Later) -> bool:
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id

    def __eq__(self, other: object) -> bool:
        return self.id == other.id


#: DuckDB's words for op11_lexical_search.
ORACLE_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS doc, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc, count(*) AS n FROM words GROUP BY doc),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sought AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT item_id, doc, doc_id, sum(repeats * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM sought JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (doc) CROSS JOIN totals GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
