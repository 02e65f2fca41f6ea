"""Token ids in Arrow files of equal-length sequences.

A file is in the Arrow IPC file format. Its batches have two columns of fixed-size lists: `ids` and `mask`, `length` values
each, so sequence i of a memory-mapped file is a slice that nobody copies. The ids of a file's documents follow each other,
each document ended by the end id; the last sequence is padded, and the mask is 0 there. Beside it lies an index file with a
row per document: its id, its first id's place in the file, and its number of ids.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import file_system, new_folder, slices, text_or_empty, written

END_ID = 1
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceIds(dict):
    """piece of a text between blanks -> its ids as bytes. Two generations of at most `limit` pieces each are kept, so frequent ones stay.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its pieces in turn. That is checked
    for the tokenizer's own parts when it is loaded: any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str, limit: int = 350_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.older = Tokenizer.from_file(path), limit, {}
        self.by_piece = self._drops_blanks(json.loads(self.tokenizer.to_str()))
        self.type = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
        self.word_end = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        if suffix:
            self.word_end[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        whole = int(self.word_end.sum()) and sum(len(w) == 1 + len(suffix) for w in self.tokenizer.get_vocab() if w.endswith(suffix)) >= 256
        self.by_piece = self.by_piece and bool(whole) and all(self._bytes(self.tokenizer.encode(p, add_special_tokens=False)) == self.of(p) for p in PROBES)

    @staticmethod
    def _drops_blanks(parts: dict) -> bool:
        """Whether the pre-tokenizer keeps only runs that can hold no blank, and no normalizer but those that see single characters."""
        pre, norm = parts.get("pre_tokenizer") or {}, parts.get("normalizer") or {}
        splits = [p for p in pre.get("pretokenizers", [pre]) if p.get("type") == "Split"]
        dropped = any(p["behavior"] == "Removed" and p["invert"] and all(x.strip("[]+").startswith(("^\\s", "\\p{L}", "\\p{N}", "'")) for x in p["pattern"].get("Regex", " ").split("|")) for p in splits)
        return dropped and {n.get("type") for n in norm.get("normalizers", [norm])} <= {"NFC", "Replace", "Lowercase"} and parts.get("post_processor") is None

    def _bytes(self, encoding) -> bytes:
        return np.array(encoding.ids, self.type).tobytes()

    def __missing__(self, piece: str) -> bytes:
        value = self.older.get(piece)
        if value is None:
            parts = parts_of(piece)
            value = self._bytes(self.tokenizer.encode(piece, add_special_tokens=False)) if parts == [piece] else b"".join(map(self.__getitem__, parts))
        self._keep(piece, value)
        return value

    def _keep(self, piece: str, value: bytes) -> None:
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = value

    def learn(self, pieces: set[str]) -> None:
        """Encode the words of pieces not yet known together, and cut the ids where words end.

        Each word is one pre-token or more, and each pre-token's last id ends a word (all bytes have such a form, which is checked at load): as
        many ends as words mean that each has one.
        """
        words = {w for p in pieces if p not in self and p not in self.older for w in parts_of(p)}
        new = [w for w in words if w.isalpha() and w not in self and w not in self.older and len(w) <= 64]
        for a in range(0, len(new), 1000):
            part = new[a : a + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.type)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(part):
                continue  # some word is more than one pre-token: each is encoded when it is met
            raw, width, at = ids.tobytes(), ids.itemsize, 0
            for piece, end in zip(part, ends.tolist(), strict=True):
                self._keep(piece, raw[at * width : end * width])
                at = end

    def forget(self) -> None:
        """Give the memory of the pieces back: the worker process that holds this goes on to other work."""
        self.clear()
        self.older = {}

    def of(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned integers of the file's width."""
        if not self.by_piece:
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False))
        return self.of_pieces(pieces_of(text))

    def of_pieces(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))


def pieces_of(text: str) -> list[str]:
    """The text cut at white space; the four separators that Python counts as such and the tokenizer does not stay in their pieces."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return _BLANKS.split(text)
    return text.split()


def parts_of(piece: str) -> list[str]:
    """A piece cut where the tokenizer cuts in any case: ASCII between letters, digits and marks, in lower case; others before closing marks.

    What counts is the word in normal form and lower case: that of a dotted capital I ends in a combining dot, which the tokenizer joins with
    the marks after it. So the cut is made only where the form ends in a letter of the alphabets below, which are old enough for all engines to agree on.
    """
    if piece.isascii() and "'" not in piece and "<" not in piece:
        return _ASCII_PARTS.findall(piece.lower())
    core = piece.rstrip(MARKS)
    cut = len(core) < len(piece) and core.isalpha() and _SURE_LETTER.fullmatch(unicodedata.normalize("NFC", core[-8:]).lower()[-1:])
    return [core, piece[len(core) :]] if cut else [piece]


_SURE_LETTER = re.compile("[a-z\u00df-\u00f6\u00f8-\u017f\u03b1-\u03c9\u0430-\u045f]")
_ASCII_PARTS = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")
#: Marks that may follow a word, and texts on which the shortcut is compared with the tokenizer when it is loaded.
MARKS = ".,;:!?"
PROBES = ("Some words, some MORE words... x", "É déjà-vu: l'été 12.5 don't", "a_b c@d.e \u4e2d\u6587!?")
_BLANKS = re.compile(r"[ \t-\r]+")
_loaded: dict[str, PieceIds] = {}


def piece_ids(path: str) -> PieceIds:
    """The tokenizer of this worker process, kept from task to task; the pieces it has met are not."""
    if path not in _loaded:
        _loaded[path] = PieceIds(path)
    return _loaded[path]


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes a batch whenever `batch_rows` of them are full. Ids of small vocabularies take two bytes."""

    def __init__(self, fs, path: str, length: int, batch_rows: int, width: str):
        self.length, self.batch_rows, self.type = length, batch_rows, np.dtype(width)
        self.row_bytes = self.type.itemsize * length
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.type), length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"end_id": str(END_ID)})
        self.out = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.parts: list[bytes] = []
        self.held = 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.batch_rows * self.row_bytes:
            self._flush(self.held // self.row_bytes)

    def _flush(self, rows: int) -> None:
        data = b"".join(self.parts)
        n = min(len(data), rows * self.row_bytes) // self.type.itemsize
        ids, mask = np.zeros(rows * self.length, self.type), np.zeros(rows * self.length, bool)
        ids[:n], mask[:n] = np.frombuffer(data, self.type, n), True
        self.parts, self.held = [data[n * self.type.itemsize :]], len(data) - n * self.type.itemsize
        for a in range(0, rows, self.batch_rows):
            cut = slice(a * self.length, min(rows, a + self.batch_rows) * self.length)
            self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids[cut]), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask[cut]), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._flush(-(-self.held // self.row_bytes))
        self.file.close()
        self.out.close()


def write_token_files(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = 2048,
    batch_rows: int = 64, file_bytes: int = 64 << 20,
) -> DataFrame:
    """Write the ids of all texts in ascending order of id; returns the manifest (file, path, docs, tokens), files numbered in that order.

    Rows are range-partitioned by id into parts of about file_bytes of text; each task writes one file and its index. A task
    that is run again writes files of new names; only those of the manifest count.

    Defined cases: a null text has the end id alone; no rows give an empty manifest. A null id comes first. Rows
    that repeat an id follow each other in order of text.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    ordered = rows.repartitionByRange(int(parts), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        pieces, name, out, at = piece_ids(path), f"{base}/{uuid.uuid4().hex}.arrow", None, 0
        ids: list[int | None] = []
        lengths: list[int] = []
        end = np.array([END_ID], pieces.type).tobytes()
        for batch in slices(batches, "text"):
            out = out or SequenceWriter(fs, name, length, batch_rows, pieces.type)
            texts = batch.column("text").to_pylist()
            lists = [pieces_of(t) for t in texts] if pieces.by_piece else None
            if lists:
                pieces.learn(set().union(*lists))
            for i, (doc, text) in enumerate(zip(batch.column("id").to_pylist(), texts, strict=True)):
                data = (pieces.of_pieces(lists[i]) if lists else pieces.of(text)) + end
                out.add(data)
                ids.append(doc)
                lengths.append(len(data) // len(end))
        pieces.forget()
        if out:
            out.close()
            n = np.array(lengths, np.int64)
            at = int(n.sum())
            with fs.open_output_stream(name + ".index") as sink, pa.ipc.new_file(sink, INDEX) as index:
                index.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n)], schema=INDEX))
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [name], "docs": [len(ids)], "tokens": [at]})

    return written(ordered.mapInArrow(write, "part long, path string, docs long, tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per document, from the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32 and file."""
    before = F.coalesce(F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per file
    files = manifest.withColumn("before", before).select("path", "before")
    files = files.repartition(max(1, min(manifest.count(), 10_000)), "path")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for path, before in ((p, b) for batch in batches for p, b in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True)):
            with fs.open_input_file(path + ".index") as source:
                index = pa.ipc.open_file(source).read_all()
            starts, counts = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
            crcs = np.zeros(len(starts), np.int64)
            with fs.open_input_file(path) as source:
                sequences = pa.ipc.open_file(source)
                doc = offset = 0
                for k in range(sequences.num_record_batches):
                    batch = sequences.get_batch(k)
                    ids = batch.column("ids").values.to_numpy()[: batch.column("mask").values.true_count].astype("<u4")  # padding is at the end
                    while doc < len(starts) and starts[doc] < offset + len(ids):  # a document's ids may go on in the next batch
                        a, b = max(starts[doc], offset) - offset, min(starts[doc] + counts[doc] - offset, len(ids))
                        crcs[doc] = zlib.crc32(ids[a:b].tobytes(), int(crcs[doc]))
                        if starts[doc] + counts[doc] > offset + len(ids):
                            break
                        doc += 1
                    offset += len(ids)
            yield pa.RecordBatch.from_pydict({"doc_id": index.column("doc_id").combine_chunks(), "start": pa.array(before + starts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crcs), "file": pa.array([path] * len(starts), pa.string())})

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_files_round_trip(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Write the token files of docs to the shared folder and return what a reader finds in them, a row per document."""
    folder = new_folder(spark, "tokens")
    return read_token_files(write_token_files(docs, folder, **options), folder)
