"""Language identification with a string kernel.

The kernel of two texts counts the character n-grams (n = 1 to 4, a blended spectrum) that occur in both, whatever their
number, divided by the geometric mean of their own counts. Nyström landmarks approximate it: a text is described by its
kernel values with a few hundred landmark texts. One-versus-rest kernel ridge regression on those gives a weight per landmark
and language. As the kernel is a product of presence vectors, landmarks x weights is one small matrix, and a batch of texts is scored
by one sparse matrix product with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import slices, written

ORDERS, SLOTS = 4, 1 << 16
UNKNOWN = "und"


def presence(text: str) -> np.ndarray:
    """The slots (0 to 65535) of the n-grams that occur in a text, in order. Case is ignored, a run of blanks or digits is one character."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    blank = (points <= 32) | ((points >= 48) & (points <= 57))
    points = np.where(blank, np.uint32(32), points)
    points = points[~(blank & np.concatenate(([False], blank[:-1])))] if len(points) else points
    if not len(points):
        return np.empty(0, np.int64)
    points = np.concatenate((np.uint32([32]), points, np.uint32([32])))
    seen, value = np.zeros(SLOTS, bool), np.zeros(len(points), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(points) < n:
            break
        value = value[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(n)
        h = value * np.uint32(0x9E3779B1)
        seen[(h ^ (h >> np.uint32(15))) >> np.uint32(16)] = True
    return np.flatnonzero(seen)


def letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """languages, and the matrix (slots x languages) that is landmarks x weights."""

    languages: tuple[str, ...]
    matrix: np.ndarray

    def scores(self, slots: list[np.ndarray]) -> np.ndarray:
        """Regression values, a row per text: the product of the batch's normalised presence vectors with the matrix."""
        out = np.zeros((len(slots), len(self.languages)))
        lengths = np.array([len(s) for s in slots])
        if full := np.flatnonzero(lengths).tolist():
            for part in np.array_split(full, -(-int(lengths.sum()) // 500_000)):  # a row of the matrix per n-gram present is gathered: so many at a time
                if len(part):
                    edges = np.cumsum(lengths[part]) - lengths[part]
                    out[part] = np.add.reduceat(self.matrix[np.concatenate([slots[i] for i in part])], edges, axis=0) / np.sqrt(lengths[part])[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [letters(t) for t in texts]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        values = self.scores([presence(t) if k else np.empty(0, np.int64) for t, k in zip(texts, known, strict=True)])
        best = values.argmax(axis=1)
        top = np.clip(values[np.arange(len(texts)), best], 0.0, 1.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)], [float(s) if k else 0.0 for s, k in zip(top.tolist(), known, strict=True)]


def is_held_out(id_col, part: int = 2, of: int = 4):
    return (F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % of) == part


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_a_language: int = 1500, landmarks: int = 256, ridge: float = 1e-3) -> Model:
    """Fit on labelled, not held-out rows: about rows_a_language different texts of each language, chosen by a hash of the text, whole texts.

    All languages are learned; one with fewer texts is learned from all it has. The landmarks are the sample's first texts of each language in
    order of that hash, as many of each and `landmarks` in all, but four of each at least and 64 at most. These three numbers are the only bounds. Tasks
    turn sample texts into kernel rows and sums of their products; the driver solves a system of as many unknowns as landmarks.

    Defined cases: rows without text, label, or id not held out are as stated: a null text or label is not learned from, a null id is the empty
    one. Copies of a text count once in each language that they are labelled with. No rows give a model without languages.
    """
    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"))
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~is_held_out(F.col("id")))
    labelled = labelled.select("lang", "text", F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 40)).alias("draw"))
    counts = written(labelled.select("lang", "draw").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-counts")
    limits = counts.select("lang", (F.least(F.lit(1.0), rows_a_language / F.col("n")) * (1 << 40)).cast("long").alias("limit"))
    sample = labelled.join(F.broadcast(limits), "lang").filter("draw < limit")  # a row per language
    sample = sample.groupBy("lang", "draw").agg(F.first("text").alias("text"))

    def present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("draw"), pa.array([presence(t).astype(np.uint16).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["lang", "draw", "slots"])

    sample = written(sample.select("lang", "draw", "text").mapInArrow(present, "lang string, draw long, slots binary"), "language-sample")
    languages = tuple(r.lang for r in counts.select("lang").orderBy("lang").collect())
    if not languages:
        return Model((), np.zeros((SLOTS, 0)))
    of_each = min(64, max(4, landmarks // len(languages)))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("draw"))  # some rows_a_language rows
    chosen = [np.frombuffer(r.slots, np.uint16) for r in sample.withColumn("nth", nth).filter(F.col("nth") <= of_each).orderBy("lang", "nth").select("slots").collect()]
    m, number = len(chosen), {lang: i for i, lang in enumerate(languages)}
    base = np.zeros((SLOTS, m), np.float32)
    for j, slots in enumerate(chosen):
        base[slots.astype(np.int64), j] = 1 / np.sqrt(max(1, len(slots)))
    shared = docs.sparkSession.sparkContext.broadcast(base)  # slots x landmarks: its size is fixed by the parameters

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, target, base = np.zeros((m, m)), np.zeros((m, len(languages))), shared.value
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                slots = np.frombuffer(raw, np.uint16).astype(np.int64)
                row = base[slots].sum(axis=0, dtype=np.float64) / np.sqrt(max(1, len(slots)))
                gram += np.outer(row, row)
                target[:, number[lang]] += row
        yield pa.RecordBatch.from_pydict({"gram": [gram.tobytes()], "target": [target.tobytes()]})

    gram, target = np.zeros((m, m)), np.zeros((m, len(languages)))
    for r in sample.repartition(8, "draw").mapInArrow(products, "gram binary, target binary").toLocalIterator():
        gram += np.frombuffer(r.gram).reshape(m, m)
        target += np.frombuffer(r.target).reshape(m, -1)
    shared.unpersist()
    kernel = (base.T @ base).astype(np.float64)
    scale = np.trace(gram) / m
    weights = np.linalg.solve(gram + ridge * scale * kernel + 1e-8 * scale * np.eye(m), target)
    return Model(languages, base @ weights.astype(np.float32))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred and score. A prediction sees the whole text and nothing else.

    Defined cases: a null text, or one without a letter, is `und` with score 0, as is any text where no language was learned. No
    rows give no rows. Equal texts get equal results.
    """
    rows = docs.select(F.col(id_col).alias("id"), is_held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots x languages

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lang, score = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    types = f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return rows.mapInArrow(predict, types).withColumnRenamed("id", id_col)


def drop_unidentified(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """docs without the rows that are `und` or score below least_score; all columns stay, nothing is shuffled.

    Defined cases: null texts and those without a letter go; no rows give no rows; equal texts go or stay together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            lang, score = shared.value.predict(batch.column(text_col).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and s >= least_score for x, s in zip(lang, score, strict=True)]))

    return docs.mapInArrow(known, docs.schema)
