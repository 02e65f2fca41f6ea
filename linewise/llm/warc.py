"""WARC archives compressed record by record with a Zstandard dictionary of their own.

An archive starts with a skippable frame that holds the dictionary, built from the first records of that archive. Each
record follows as a frame of its own, so a reader can start at any record's offset once it has the dictionary.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, if_small, new_folder, slices, written

#: Fixed values of the WARC and Zstandard formats.
SKIPPABLE_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _plain(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP head but no payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if is_revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date),
        ("WARC-Target-URI", _plain(url) if url else f"urn:page:{page_id}"), ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if is_revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields), b"", b""]) + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP head and payload of a record; raises ValueError on a malformed one."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] != VERSION.decode():
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} has {len(rest) - 4} bytes, not {n}")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, http, payload


def build_dictionary(records: list[bytes], size: int) -> bytes:
    """A Zstandard dictionary from sample records, or b"" where they are too few or too short to learn from."""
    total = sum(map(len, records))
    if len(records) < 16 or total < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 8), records, k=512, d=8, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes an archive to an open binary stream. The first `sample_bytes` of records wait until the dictionary is built."""

    def __init__(self, out, dictionary_bytes: int, sample_bytes: int, level: int):
        self.out, self.size, self.sample_bytes, self.level = out, dictionary_bytes, sample_bytes, level
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.records = self.written = 0
        self.compressor = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor:
            self._put(self.compressor.compress(record))
            return
        self.waiting.append(record)
        self.waiting_bytes += len(record)
        if self.waiting_bytes >= self.sample_bytes:
            self._start()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _start(self) -> None:
        raw = build_dictionary([r[:65536] for r in self.waiting], self.size)
        if raw:
            self._put(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_content_size=True, write_checksum=True)
        for record in self.waiting:
            self._put(self.compressor.compress(record))
        self.waiting = []

    def close(self) -> None:
        if not self.compressor:
            self._start()


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, frame by frame; memory holds one record and one chunk of input."""
    pending = stream.read(8)
    raw = None
    if len(pending) == 8 and struct.unpack("<I", pending[:4])[0] == SKIPPABLE_MAGIC:
        raw, pending = stream.read(struct.unpack("<I", pending[4:])[0]), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    while True:
        if not pending and not (pending := stream.read(chunk)):
            return
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(pending))
            if frame.eof:
                pending = frame.unused_data
                break
            if not (pending := stream.read(chunk)):
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def first_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_revisit_bytes: int = 100) -> DataFrame:
    """(of_sha, first_page): the smallest id of the pages of each payload that several have. Only ids and digests are shuffled, summed up before."""
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    light = pages.select(F.col(id_col).cast("long").alias("page"), F.octet_length(payload).alias("n"), F.sha2(payload, 256).alias("of_sha")).filter(F.col("n") >= min_revisit_bytes)
    first = light.groupBy("of_sha").agg(F.min("page").alias("first_page"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    return written(first, "payloads")


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 100,
    dictionary_bytes: int = 64 * 1024, sample_bytes: int = 2 << 20, level: int = 3, archive_bytes: int = 256 << 20, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record for each page to archives in folder; returns the manifest (path, records, bytes).

    A dictionary is trained on the first 64 KB of each of an archive's first records, sample_bytes in all: it changes how small the archive is, not
    what it holds.

    Of pages with equal payloads of at least min_revisit_bytes, the one with the smallest id is a response and others
    revisit it. Each task writes archives of its own and starts a new one beyond archive_bytes. A task that is run again
    writes new files; only files of the manifest count.

    Defined cases: a null html is an empty payload; no pages give no archives and an empty manifest. A null id is larger
    than any other and is read back as null. Rows that repeat the smallest id and payload are all responses.
    """
    first = if_small(first_pages(pages, id_col, html_col, min_revisit_bytes), 100_000)  # some 100 bytes a row
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    # broadcast, no page moves; else adaptive execution can split the pages of a payload that very many have
    rows = rows.withColumn("sha", F.sha2(F.encode("html", "UTF-8"), 256)).join(first, F.col("sha") == F.col("of_sha"), "left")
    again = F.col("first_page").isNotNull() & ~F.col("page").eqNullSafe(F.col("first_page"))
    rows = rows.select("page", "url", "html", "sha", F.when(again, F.col("first_page")).alias("refers_to"), again.alias("again"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        out = writer = path = None
        done: list[tuple[str, int, int]] = []

        def finish() -> None:
            nonlocal writer
            if writer:
                writer.close()
                out.close()
                done.append((path, writer.records, writer.written))
                writer = None

        for batch in slices(batches, "html"):
            for page, url, html, sha, refers_to, again in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "sha", "refers_to", "again")), strict=True):
                if not writer:
                    path = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(path)
                    writer = ArchiveWriter(out, dictionary_bytes, sample_bytes, level)
                writer.add(record_bytes(page, url, html.encode("utf-8"), sha, refers_to, bool(again), date))
                if writer.written >= archive_bytes:
                    finish()
        finish()
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "records", "bytes"), map(list, zip(*done, strict=True)), strict=True)))

    return written(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the archives of a manifest: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Lengths and digests of responses are those of the bytes read, and must agree with the header; a revisit has those of its header
    and no payload.

    Defined cases: an empty manifest gives no rows. A record that was written without an id or address has a null id, and the address `urn:page:None`.
    A file that is cut short or does not match its headers raises ValueError.
    """
    n = manifest.count()  # archives, not records
    paths = manifest.select("path").repartition(max(1, min(n, 10_000)), "path")

    def page(value: str | None) -> int | None:
        number = value[len("<urn:page:") : -1] if value else "None"
        return None if number == "None" else int(number)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        rows, size = [], 0
        for path in (p for b in batches for p in b.column("path").to_pylist()):
            with fs.open_input_stream(path) as stream:
                for record in read_archive(stream):
                    fields, http, payload = parse_record(record)
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{path}: the payload of {fields['WARC-Record-ID']} does not match its header")
                    rows.append((page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, page(fields.get("WARC-Refers-To")), length, digest, payload if kind == "response" else None))
                    size += len(payload)
                    if size > 4 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return paths.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def warc_round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write archives of all pages, read them back and return what the records say."""
    folder = new_folder(spark, "warc")
    return read_warc(write_warc(pages, folder, **options), folder)


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first_page FROM p WHERE n >= 100 GROUP BY sha)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.sha AS payload_digest,
       CASE WHEN f.first_page <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_page <> p.page_id THEN f.first_page END AS refers_to
FROM p LEFT JOIN f ON p.sha = f.sha
"""
