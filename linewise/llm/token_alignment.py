"""Alignment of two tokenizers' tokens over the same bytes, by byte-owner arrays.

Each tokenizer's tokens own the bytes of a text: repeating a token's number once for each of its bytes gives the owners of all bytes.
Where the pair of owners changes a new overlap begins; where both change at once the text can be cut, and the pieces between cuts are
groups. Every token of a group is linked with every token of the other tokenizer in it. How many documents hold a pair of ids linked is counted over
the whole corpus.

A text is cut at single blanks between other characters, where both tokenizers cut in any case, so each piece is encoded
and aligned once and kept for a task. That no token of either spans such a blank is checked when the tokenizers are loaded; others encode whole texts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, slices, written, written_at

#: Pairs of ids that every task holds with their counts; counts of the other, rarer pairs are joined.
HELD_PAIRS = 1 << 21
#: Pieces of text that a task keeps before it drops all but the third of them that were met most, and bytes of text taken at once.
KEPT = 180_000
TEXT_BYTES = 2_000_000
#: About the bytes of the pieces, their groups as text and their pairs that a task keeps; 180,000 words have some 25 MB, as many lines without blanks would have gigabytes.
KEPT_BYTES = 64_000_000
#: Bytes of slices that a task writes, and later reads, at once.
SLICE_BYTES = 16_000_000
#: Pieces encoded at once.
AT_ONCE = 2000
#: A group with more links than this is counted by different ids instead of link by link.
DENSE = 4096
_ODD_BLANKS = re.compile(r" \s|\s ")
_SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")
_PROBES = ("one two", "Ein Wort, ZWEI", "1 2", "é à", "a' 's", "中 文", "x. (y", "<s> <|endoftext|>")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(text: str) -> list[str]:
    """The text cut at single blanks that stand between other characters than white space."""
    if text.startswith(" ") or text.endswith(" ") or _ODD_BLANKS.search(text):
        return _SINGLE_BLANK.split(text)
    return text.split(" ")


def overlaps_and_cuts(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, ends): the tokens of each overlap in order, and whether both tokens end with it. Lengths are bytes of tokens and have the same sum."""
    owner_a, owner_b = (np.repeat(np.arange(len(x)), x) for x in (lengths_a, lengths_b))
    if not len(owner_a):
        return owner_a, owner_b, np.empty(0, bool)
    new_a, new_b = (x[1:] != x[:-1] for x in (owner_a, owner_b))
    last = np.append(np.flatnonzero(new_a | new_b), len(owner_a) - 1)
    return owner_a[last], owner_b[last], np.append(new_a & new_b, True)[last]


class Tokenizers:
    """Both tokenizers, with the bytes of each of their ids."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = _byte_letters()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.size_b = len(self.bytes_b)
        if len(self.bytes_a) * self.size_b >= 1 << 40:
            raise ValueError("vocabularies with 2^40 pairs or more are not supported")
        self.text_a, self.text_b = ([str(i) for i in range(len(own))] for own in (self.bytes_a, self.bytes_b))
        joined = all("▁" not in p.lstrip("▁") for p in pieces) and " ".join(_PROBES) == self.b.normalize(" ".join(_PROBES)).removeprefix("▁").replace("▁", " ")
        self.by_piece = joined and all(self.encoded(p)[k] == sum((self.encoded(x)[k] for x in p.split(" ")), []) for p in (*_PROBES, " ".join(_PROBES)) for k in (0, 1))

    def encoded(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of blank and text by the first, of the text by the second, which adds a blank."""
        return self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number for a pair of ids."""
        return a * self.size_b + b

    def group_pairs(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(different pairs of ids of one large group, links of each)."""
        (a, times_a), (b, times_b) = (np.unique(x, return_counts=True) for x in (ids_a, ids_b))
        return self.pair(a[:, None], b[None]).ravel(), (times_a[:, None] * times_b[None]).ravel()

    def fits(self, text: str, ids_a: list[int], ids_b: list[int]) -> bool:
        own = (" " + text).encode()
        return b"".join(map(self.bytes_a.__getitem__, ids_a)) == own and b"".join(map(self.bytes_b.__getitem__, ids_b)) == own


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones of Latin-1 stand for themselves, the others for 256, 257, ... in turn."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _size(pieces: list[str], texts: list[str], pairs: int) -> int:
    return sum(map(len, pieces)) + sum(map(len, texts)) + 16 * pairs


class Pieces:
    """What the pieces met so far give: numbers of tokens, groups, links and pairs of ids (columns of `table`), the pairs, and the groups as text."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.met = np.empty(0, np.int64)
        self.bytes = 0
        self.parts = [(np.zeros((0, 6), np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        self._gather()

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The number of each piece, after learning those not yet known."""
        if len(self.number) > KEPT or self.bytes > KEPT_BYTES:
            self._drop_rare()
        new = list(set(pieces) - self.number.keys())
        plain = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        for at in range(0, len(plain), AT_ONCE):
            self._learn(plain[at : at + AT_ONCE])
        for piece in set(new) - set(plain):  # blanks at an end would meet those between pieces
            self._learn([piece])
        self._gather()
        numbers = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        self.met = np.concatenate((self.met, np.zeros(len(self.number) - len(self.met), np.int64))) + np.bincount(numbers, minlength=len(self.number))
        return numbers

    def _drop_rare(self) -> None:
        pieces, texts = list(self.number), self.texts
        kept = np.argsort(-self.met, kind="stable")[: KEPT // 3]
        sizes = np.cumsum([_size([pieces[i]], [texts[i]], n) for i, n in zip(kept.tolist(), self.table[kept, 4].tolist(), strict=True)])
        kept = np.sort(kept[: int(np.searchsorted(sizes, KEPT_BYTES // 3, "right"))])
        self.bytes = int(sizes[len(kept) - 1]) if len(kept) else 0
        at = stretches(self.first[kept], self.table[kept, 4])
        self.parts = [(self.table[kept], self.keys[at], self.links[at])]
        self.number, self.texts, self.met = {pieces[i]: n for n, i in enumerate(kept.tolist())}, [texts[i] for i in kept.tolist()], self.met[kept]

    def _gather(self) -> None:
        self.table, self.keys, self.links = (np.concatenate(x, axis=0) for x in zip(*self.parts, strict=True))
        self.parts = [(self.table, self.keys, self.links)]
        self.first = np.cumsum(self.table[:, 4]) - self.table[:, 4]

    def _learn(self, pieces: list[str]) -> None:
        t, text = self.tokenizers, " ".join(pieces)
        ids_a, ids_b = t.encoded(text)
        fits = t.fits(text, ids_a, ids_b)
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        starts = np.cumsum([0, *(len(p.encode()) + 1 for p in pieces)])
        at_a, at_b = (np.cumsum(x) - x for x in (t.length_a[ids_a], t.length_b[ids_b]))
        if not fits or not (np.isin(starts[:-1], at_a).all() and np.isin(starts[:-1], at_b).all()):
            if len(pieces) > 1:
                for p in pieces:
                    self._learn([p])
            else:
                self._add(pieces, np.array([[0, 0, 0, 0, 0, 1]]), np.empty(0, np.int64), np.empty(0, np.int64), [""])
            return
        a, b, ends = overlaps_and_cuts(t.length_a[ids_a], t.length_b[ids_b])
        last_a, last_b = a[ends], b[ends]
        first_a, first_b = (np.concatenate(([0], x[:-1] + 1)) for x in (last_a, last_b))
        of_a, of_b = last_a - first_a + 1, last_b - first_b + 1
        piece = np.searchsorted(starts, at_a[first_a], "right") - 1  # of each group
        links = of_a * of_b
        rows = np.zeros((len(pieces), 6), np.int64)
        for k, x in enumerate((of_a, of_b, np.ones_like(of_a), links)):
            np.add.at(rows[:, k], piece, x)
        few = links <= DENSE
        group_of_a = np.repeat(np.arange(len(few)), np.where(few, of_a, 0))
        token_a = np.arange(len(ids_a))[np.repeat(few, of_a)]
        times = of_b[group_of_a]
        group = np.repeat(group_of_a, times)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(times) - times, times)
        found = [(piece[group], t.pair(np.repeat(ids_a[token_a], times), ids_b[first_b[group] + nth]), np.ones(len(group), np.int64))]
        for g in np.flatnonzero(~few):
            keys, n = t.group_pairs(ids_a[first_a[g] : last_a[g] + 1], ids_b[first_b[g] : last_b[g] + 1])
            found.append((np.full(len(keys), piece[g]), keys, n))
        own, keys, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort((own << 40) | keys)
        own, keys, n = own[order], keys[order], n[order]
        first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (keys[1:] != keys[:-1]))[: len(own)])
        n, keys, own = np.add.reduceat(n, first), keys[first], own[first]
        rows[:, 4] = np.bincount(own, minlength=len(pieces))
        write_a, write_b = [t.text_a[i] for i in ids_a.tolist()], [t.text_b[i] for i in ids_b.tolist()]
        places = zip(first_a.tolist(), (last_a + 1).tolist(), first_b.tolist(), (last_b + 1).tolist(), strict=True)
        groups = [f"{write_a[i]}|{write_b[k]}" if j == i + 1 and m == k + 1 else f"{','.join(write_a[i:j])}|{','.join(write_b[k:m])}" for i, j, k, m in places]
        edges = np.cumsum([0, *rows[:, 2].tolist()]).tolist()
        self._add(pieces, rows, keys, n, [";".join(groups[i:j]) for i, j in zip(edges, edges[1:], strict=False)])

    def _add(self, pieces: list[str], rows: np.ndarray, keys: np.ndarray, n: np.ndarray, texts: list[str]) -> None:
        for piece in pieces:
            self.number[piece] = len(self.number)
        self.parts.append((rows, keys, n))
        self.texts += texts
        self.bytes += _size(pieces, texts, len(keys))

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all pieces, how many of them each text has): none for texts without tokens."""
        lists = [(pieces_of(x) if self.tokenizers.by_piece else [x]) if x else [] for x in texts]
        number, lengths = self.numbers([p for own in lists for p in own]), np.array([len(own) for own in lists], np.int64)
        bad = sums(self.table[number, 5], lengths) > 0
        number = number[~np.repeat(bad, lengths)]
        lengths[bad] = 0
        return number, lengths


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of values, of the given lengths."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)))
    return np.diff(total[np.concatenate(([0], np.cumsum(lengths)))], axis=0)


def stretches(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes first, first + 1, ... of each stretch, one stretch after the other."""
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // count}", count).astype(np.int64) if count else np.empty(0, np.int64)


class Slice:
    """Some documents' pieces: for each document the different ones with how often they occur, for each piece its pairs of ids with their links."""

    FIELDS = ("n_docs", "n_own", "n_pieces", "n_pairs", "lengths", "own", "times", "n_pairs_of", "pairs", "links")
    SCHEMA = "n_docs int, n_own long, n_pieces long, n_pairs long, lengths binary, own binary, times binary, n_pairs_of binary, pairs binary, links binary"

    @staticmethod
    def of(pieces: Pieces, number: np.ndarray, lengths: np.ndarray) -> tuple:
        """The columns of FIELDS."""
        used, local = np.unique(number, return_inverse=True)
        own, times = np.unique((np.repeat(np.arange(len(lengths)), lengths) << 32) | local, return_counts=True)
        counts = pieces.table[used, 4]
        at = stretches(pieces.first[used], counts)
        lengths = np.bincount(own >> 32, minlength=len(lengths))
        return (len(lengths), len(own), len(used), len(at), packed(lengths), packed(own & 0xFFFFFFFF), packed(times), packed(counts), packed(pieces.keys[at]), packed(pieces.links[at]))

    def __init__(self, n_docs: int, n_own: int, n_pieces: int, n_pairs: int, lengths: bytes, own: bytes, times: bytes, n_pairs_of: bytes, pairs: bytes, links: bytes):
        self.lengths, self.own, self.times = unpacked(lengths, n_docs), unpacked(own, n_own), unpacked(times, n_own)
        self.counts, self.pairs, self.links = unpacked(n_pairs_of, n_pieces), unpacked(pairs, n_pairs), unpacked(links, n_pairs)
        self.first = np.cumsum(self.counts) - self.counts
        self.doc = np.repeat(np.arange(n_docs), self.lengths)

    @classmethod
    def row(cls, batch: pa.RecordBatch, k: int) -> Slice:
        """That of one row: the others' columns stay as Arrow has them."""
        return cls(*(batch.column(c)[k].as_py() for c in cls.FIELDS))

    def by_document(self) -> np.ndarray:
        """The pairs of every document, each once a document."""
        times = self.counts[self.own]
        met = np.sort((np.repeat(self.doc, times) << 40) | self.pairs[stretches(self.first[self.own], times)])
        return met[np.append(True, met[1:] != met[:-1])[: len(met)]] & ((1 << 40) - 1)

    def valued(self, held: np.ndarray, counts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """(n_best and count_sum of each document by the pairs held, (document, pair, links) of the others)."""
        at = np.minimum(np.searchsorted(held, self.pairs), max(0, len(held) - 1))
        known = held[at] == self.pairs if len(held) else np.zeros(len(self.pairs), bool)
        value = np.zeros((len(self.pairs), 2), np.int64)
        value[known, 0], value[known, 1] = self.links[known] * best[at[known]], self.links[known] * counts[at[known]]
        of_piece = sums(value, self.counts)
        out = sums(of_piece[self.own] * self.times[:, None], self.lengths)
        rare = np.flatnonzero(sums((~known).astype(np.int64), self.counts)[self.own])
        times = self.counts[self.own[rare]]
        at = stretches(self.first[self.own[rare]], times)
        doc, links = np.repeat(self.doc[rare], times), np.repeat(self.times[rare], times) * self.links[at]
        return out, tuple(x[~known[at]] for x in (doc, self.pairs[at], links))


def aligned_slices(rows: DataFrame, paths: tuple[str, str], groups: bool) -> DataFrame:
    """A row for each slice of (doc, text): the documents with their numbers, and the columns of Slice."""
    kind = rows.schema["doc"].dataType.simpleString()

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(loaded(*paths))
        for batch in slices(batches, "text", TEXT_BYTES):
            number, lengths = pieces.of_texts(batch.column("text").to_pylist())
            table = sums(pieces.table[number], lengths)
            texts, edges = list(map(pieces.texts.__getitem__, number.tolist())), np.cumsum([0, *lengths.tolist()]).tolist()
            joined = [";".join(texts[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
            digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in joined]
            docs = pa.StructArray.from_arrays([batch.column("doc"), *(pa.array(table[:, k]) for k in range(4)), pa.array(digests, pa.string()), pa.array(joined if groups else [None] * len(joined), pa.string())], names=DOC)
            columns = Slice.of(pieces, number, lengths)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), *(pa.array([x], _TYPES.get(k, pa.binary())) for k, x in zip(Slice.FIELDS, columns, strict=True))], names=["docs", *Slice.FIELDS])

    doc = f"doc: {kind}, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, groups: string"
    return rows.mapInArrow(align, f"docs array<struct<{doc}>>, {Slice.SCHEMA}")


DOC = ["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
_TYPES = {"n_docs": pa.int32(), "n_own": pa.int64(), "n_pieces": pa.int64(), "n_pairs": pa.int64()}


def count_pairs(aligned: DataFrame) -> DataFrame:
    """(pair, count): how many documents hold each pair of ids linked; counted within tasks first."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        waiting: list[np.ndarray] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate((np.empty(0, np.int64), *waiting)), return_counts=True)
            waiting.clear()
            every, times = np.concatenate((keys, new)), np.concatenate((counts, times))
            order = np.argsort(every, kind="stable")
            every, times = every[order], times[order]
            first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
            return (every[first], np.add.reduceat(times, first)) if len(first) else (every, times)

        for row in (Slice.row(batch, k) for batch in batches for k in range(batch.num_rows)):
            waiting.append(row.by_document())
            if sum(map(len, waiting)) > 4_000_000:
                keys, counts = merged()
                if len(keys) > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "count"])
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["pair", "count"])

    return aligned.select(*Slice.FIELDS).mapInArrow(count, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def valued_pairs(counts: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): with whether no other pair of the first id is in more documents."""
    named = counts.withColumn("a", F.expr(f"pair div {size_b}").cast("int"))
    most = named.groupBy("a").agg(F.max("count").alias("most"))  # a row for each id of a vocabulary
    return named.join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def least_held(pairs: DataFrame, most: int) -> int:
    """The least count of pairs of which, with all that have more, there are no more than `most`; by steps of the sixteenth root of two."""
    step = F.floor(F.log2("count") * 16)
    rows = pairs.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.min("count").alias("least")).orderBy(F.desc("step")).collect()
    held, least = 0, 1 << 62
    for row in rows:
        held += row.pairs
        if held > most:
            break
        least = row["least"]
    return least


_tokenizers: dict[tuple[str, str], Tokenizers] = {}
_values: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def loaded(path_a: str, path_b: str) -> Tokenizers:
    """The tokenizers of this process."""
    if (path_a, path_b) not in _tokenizers:
        _tokenizers[path_a, path_b] = Tokenizers(path_a, path_b)
    return _tokenizers[path_a, path_b]


def held_pairs(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted pairs, counts, best) of that table; each worker process keeps those of one."""
    if path not in _values:
        _values.clear()
        fs, at = file_system(path)
        rows = pads.dataset(at, filesystem=fs, format="parquet").to_table()
        keys = rows.column("pair").to_numpy()
        order = np.argsort(keys)
        _values[path] = keys[order], rows.column("count").to_numpy()[order], rows.column("best").to_numpy()[order]
    return _values[path]


def align_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[str, str] | None = None, held: int = HELD_PAIRS, groups: bool = True,
) -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups.

    groups lists the ids of both tokenizers by group, `a1,a2|b1;a3|b2,b3`. count_sum adds over all links the number of documents that hold the link's
    pair of ids linked, n_best counts the links of whose first id no pair is in more documents. Texts are encoded once; their pieces' pairs are written,
    counted, and read again with the counts at hand: every task has those of the most frequent pairs, `held` at most, the others join by pair.

    Defined cases: no rows give no rows. Null and empty texts, and texts whose tokens' bytes are not those of a blank and the text, have no
    tokens: zeros, and '' for groups and their digest. A text of any length is one document. Rows that repeat an id, or have none, are documents each.
    """
    paths = tokenizers or default_tokenizers()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    aligned = written(aligned_slices(rows, paths, groups), "aligned-slices", SLICE_BYTES)
    pairs = written(valued_pairs(written(count_pairs(aligned), "pair-counts"), loaded(*paths).size_b), "pair-values")
    least = least_held(pairs, held)
    _, path = written_at(pairs.filter(F.col("count") >= least), "pair-held")

    def value(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, values = TaskContext.get().partitionId() << 40, held_pairs(path)
        for batch in batches:
            for k in range(batch.num_rows):
                docs = batch.column("docs")[k].values
                found, (doc, pair, links) = Slice.row(batch, k).valued(*values)
                offsets = np.searchsorted(doc, np.arange(len(docs) + 1)).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(pair), pa.array(links)], names=["pair", "links"]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(docs))), *docs.flatten(), *(pa.array(x) for x in found.T), rare], names=["row", *DOC, "n_best", "count_sum", "rare"])
                row += len(docs)

    schema = f"row long, doc {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long, rare array<struct<pair: long, links: long>>"
    out = aligned.mapInArrow(value, schema)
    named = [F.col("doc").alias(id_col), "n_a", "n_b", "n_groups", "n_links"]
    if pairs.filter(F.col("count") < least).isEmpty():
        return out.select(*named, "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else []))
    out = written(out, "alignments")
    rare = out.select("row", F.explode("rare").alias("own")).select("row", "own.*").groupBy("row", "pair").agg(F.sum("links").alias("links"))
    rare = rare.join(pairs.filter(F.col("count") < least), "pair").groupBy("row")
    rare = rare.agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("count")).alias("more_sum"))
    more = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return out.join(rare, "row", "left").select(*named, more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256", *(["groups"] if groups else []))
