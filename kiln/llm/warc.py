"""WARC archives compressed by Zstandard, record by record, with a dictionary of their own.

An archive (``.warc.zst``) begins with a skippable frame that holds the dictionary, followed by one Zstandard frame a
record, so a reader can start at any record's offset and needs nothing but the file. A task streams its rows into
archives: it holds rows until they make ``SAMPLE_BYTES`` (or end), builds the dictionary from these records (each cut
to ``SAMPLE_RECORD`` bytes for it), writes the frame, then compresses what it held and all that follows. After ``archive_bytes`` it begins the next archive, with a dictionary of that archive's records.

Archives are written into the folder under names of their own; only those named in the manifest that Spark commits
count, so a retried or speculative task leaves at most a file that no manifest names. The manifest is the archives'
index too: a row per record with file, offset and length. Readers get whole files or any list of offsets.

Revisits. Of records with equal payloads of ``min_bytes`` or more, that with the largest id is the response and the
others revisit it: they hold the HTTP header only. Payloads are compared by SHA-1, SHA-256 and length. Only hashes
and ids are shuffled to find the copies; the join that marks them is split by Spark where a payload is very frequent.

Defined results. Null html: an empty payload. Null url: no target header; line breaks and other control characters
in a url are percent-encoded. Null id: the smallest id; several rows of the largest id and one payload are all
responses. Repeated rows are written as often as they occur. An empty table gives an empty manifest and no records.
Extra columns are not read. The record, not the archive, must fit in a task's memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm.common import table, written
from kiln.session import scratch_path

SAMPLE_BYTES = 4 << 20
SAMPLE_RECORD = 64 << 10
DICT_BYTES = 64 << 10
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
# The skippable frame of a dictionary, the start of any Zstandard frame, names the WARC standard gives.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNDATED = "1970-01-01T00:00:00Z"

MANIFEST = "file string, offset bigint, length bigint, id string, record_type string"
RECORDS = ("file string, offset bigint, record_type string, id string, url string, payload_digest string, "
           "payload_bytes bigint, refers_to string, payload binary")


def record_id(key: str | None) -> str:
    return f"urn:record:{'id' if key is not None else 'none'}:{quote(key or '', safe='')}"


def key_of(record: str | None) -> str | None:
    """The id that ``record_id`` was made of."""
    kind, _, rest = (record or "").removeprefix("urn:record:").partition(":")
    return unquote(rest) if kind == "id" else None


def _headers(fields: list[tuple[str, str | None]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in fields if v is not None)


def _clean(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def make_record(key: str | None, url: str | None, payload: bytes, sha1_hex: str, size: int, first: str | None,
                revisit: bool, date: str = UNDATED) -> bytes:
    """A response record, or a revisit of the record of ``first``, whose block is the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))]) + b"\r\n"
    block = http if revisit else http + payload
    head = _headers([
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{record_id(key)}>"), ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None),
        ("WARC-Refers-To", f"<{record_id(first)}>" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (x.partition(b":") for x in lines.split(b"\r\n")[1:])
    return {k.decode().lower(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in pairs}


def parse_record(raw: bytes) -> tuple | None:
    """record_type, id, url, payload_digest (hex), payload_bytes, refers_to, payload of a response or revisit
    record; None for other records. A response's digest and length are taken from its payload and must be those
    its headers state."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    h = _fields(head)
    block = rest[:int(h["content-length"])]
    if len(block) != int(h["content-length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than its header states")
    kind = h["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(_fields(http)["content-length"])
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload that does not have the digest its header states")
    return (kind, key_of(h["warc-record-id"].strip("<>")), h.get("warc-target-uri"), digest, size,
            key_of(h["warc-refers-to"].strip("<>")) if kind == "revisit" else None, payload if kind == "response" else None)


def build_dictionary(records: list[bytes], size: int = DICT_BYTES) -> zstd.ZstdCompressionDict | None:
    """A dictionary of parts that recur in ``records``; if they are too few or too alike to train one, their own
    first bytes; none without records."""
    samples = [r[:SAMPLE_RECORD] for r in records]
    if not samples:
        return None
    try:
        return zstd.train_dictionary(size, samples)
    except zstd.ZstdError:
        joined = b"".join(samples)
        return zstd.ZstdCompressionDict(joined[:size], dict_type=zstd.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Streams records into archives below ``folder``; ``index`` holds file, offset, length, id, type of each."""

    def __init__(self, folder: str, archive_bytes: int, level: int):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.archive_bytes, self.level = folder, archive_bytes, level
        self.held: list[tuple] = []
        self.held_bytes, self.out, self.index = 0, None, []

    def add(self, key: str | None, kind: str, raw: bytes) -> None:
        if self.out:
            self._put(key, kind, raw)
            return
        self.held.append((key, kind, raw))
        self.held_bytes += len(raw)
        if self.held_bytes >= SAMPLE_BYTES:
            self._open()

    def _open(self) -> None:
        name = f"part-{uuid.uuid4().hex}.warc.zst"
        self.file, self.at = f"{self.folder}/{name}", 0
        self.out = self.store.open_output_stream(f"{self.root}/{name}", compression=None)
        book = build_dictionary([raw for _, _, raw in self.held])
        packed = zstd.ZstdCompressor(level=self.level).compress(book.as_bytes()) if book else b""
        self._write(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
        self.packer = zstd.ZstdCompressor(level=self.level, dict_data=book, write_checksum=True)
        info = b"software: kiln\r\nformat: WARC File Format 1.1\r\n"
        head = _headers([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", UNDATED),
                         ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))])
        self._write(self.packer.compress(VERSION + b"\r\n" + head + b"\r\n" + info + b"\r\n\r\n"))
        held, self.held, self.held_bytes = self.held, [], 0
        for row in held:
            self._put(*row)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _put(self, key: str | None, kind: str, raw: bytes) -> None:
        if not self.out:  # the archive was full: this record begins the next one's sample
            self.add(key, kind, raw)
            return
        at = self.at
        self._write(self.packer.compress(raw))
        self.index.append((self.file, at, self.at - at, key, kind))
        if self.at >= self.archive_bytes:
            self._close()

    def _close(self) -> None:
        self.out.close()
        self.out = None

    def end(self) -> None:
        while self.held:
            self._open()
        if self.out:
            self._close()

    def indexed(self) -> pa.RecordBatch:
        rows, self.index = self.index, []
        kinds = {"file": pa.string(), "offset": pa.int64(), "length": pa.int64(), "id": pa.string(), "record_type": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def find_revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url",
                  min_bytes: int = 1000) -> DataFrame:
    """id (text), url, payload, sha1, size, first (id of the response that a revisit refers to), revisit."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256),
                             "size": F.octet_length("payload").cast("bigint")})
    same = ["sha1", "sha256", "size"]
    copies = (rows.where(F.col("size") >= min_bytes).groupBy(*same).agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").drop("n"))
    other = written(copies, "warc-copies").select(*[F.col(c).alias(f"c_{c}") for c in same], "last")
    marked = rows.join(other, [F.col(c) == F.col(f"c_{c}") for c in same], "left")
    revisit = F.col("c_sha1").isNotNull() & ~F.col("key").eqNullSafe(F.col("last"))
    return marked.select(F.col("key").cast("string").alias("id"), "url",
                         F.when(~revisit, F.col("payload")).alias("payload"), "sha1", "size",
                         F.when(revisit, F.col("last").cast("string")).alias("first"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html", url_col: str = "url",
                   min_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write archives of ``pages`` below ``folder`` (a URI on storage that all tasks reach) and return the manifest:
    file, offset, length, id, record_type of every record, committed to ``folder``/manifest."""
    rows = find_revisits(pages, id_col, html_col, url_col, min_bytes)
    folder = folder if "://" in folder else "file://" + folder.replace("file:", "", 1)

    def run(batches):
        out = ArchiveWriter(f"{folder}/archives", archive_bytes, level)
        out.store.create_dir(out.root, recursive=True)
        for batch in batches:
            for i in range(len(batch)):
                key, url, payload, sha1, size, first, revisit = (c[i].as_py() for c in batch.columns)
                out.add(key, "revisit" if revisit else "response", make_record(key, url, payload or b"", sha1, size, first, revisit))
            if out.index:
                yield out.indexed()
        out.end()
        yield out.indexed()

    path = f"{folder}/manifest"
    rows.mapInArrow(run, MANIFEST).write.parquet(path)
    spark = pages.sparkSession
    return spark.read.schema(MANIFEST).parquet(path)


def _dictionary(f) -> zstd.ZstdCompressionDict | None:
    magic, size = struct.unpack("<II", f.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary frame")
    raw = f.read(size)
    if raw[:4] == FRAME_MAGIC:
        raw = zstd.ZstdDecompressor().decompress(raw, max_output_size=1 << 26)
    return zstd.ZstdCompressionDict(raw) if raw else None


def _read_file(uri: str, spans: list[tuple[int, int]]):
    """offset and bytes of the records at ``spans`` (offset, length) of an archive, in file order."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        opener = zstd.ZstdDecompressor(dict_data=_dictionary(f))
        for offset, length in sorted(spans):
            f.seek(offset)
            yield offset, opener.decompressobj().decompress(f.read(length))


def scan_archive(uri: str, chunk: int = 1 << 20):
    """offset and bytes of every record of an archive, warcinfo included, found without an index: frame after frame."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        book = _dictionary(f)
        opener = zstd.ZstdDecompressor(dict_data=book)
        at, data = f.tell(), b""
        while data or (data := f.read(chunk)):
            frame, out, used = opener.decompressobj(), [], 0
            while not frame.eof:
                if not data and not (data := f.read(chunk)):
                    raise ValueError(f"{uri} ends within a record")
                out.append(frame.decompress(data))
                used += len(data) - len(frame.unused_data)
                data = frame.unused_data
            yield at, b"".join(out)
            at += used


def read_archives(manifest: DataFrame, with_payload: bool = True, task_bytes: int = 32 << 20,
                  span_records: int = 4096) -> DataFrame:
    """A row per record that ``manifest`` names (file, offset, length): RECORDS. Tasks read runs of neighbouring
    records by their offsets, about ``task_bytes`` each, so that a large archive is read by several and their number
    grows with the archives, not with the index; ``payload`` is null for revisits."""
    n_tasks = 1 + (manifest.agg(F.sum("length")).first()[0] or 0) // task_bytes
    spans = (manifest.select("file", "offset", "length")
             .repartitionByRange(n_tasks, "file", "offset").sortWithinPartitions("file", "offset"))

    def run(batches):
        for batch in batches:
            files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            a = 0
            while a < len(files):
                b = a
                while b < len(files) and files[b] == files[a] and b - a < span_records:
                    b += 1
                rows, held = [], 0
                for offset, raw in _read_file(files[a], list(zip(offsets[a:b], lengths[a:b]))):
                    found = parse_record(raw)
                    rows.append((files[a], offset, *(found if with_payload else (*found[:-1], None))))
                    held += len(raw) if with_payload else 0
                    if held >= SAMPLE_BYTES:
                        yield _record_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _record_batch(rows)
                a = b

    return spans.mapInArrow(run, RECORDS)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    text = pa.string()
    kinds = {"file": text, "offset": pa.int64(), "record_type": text, "id": text, "url": text, "payload_digest": text,
             "payload_bytes": pa.int64(), "refers_to": text, "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def full_payloads(records: DataFrame) -> DataFrame:
    """``records`` with the payloads of revisits filled in from the responses they refer to."""
    first = (records.where("record_type = 'response'").select(F.col("id").alias("f_id"), F.col("payload_digest").alias("f_digest"),
                                                             F.col("payload").alias("f_payload"))
             .dropDuplicates(["f_id", "f_digest"]))
    joined = records.join(first, (F.col("record_type") == "revisit") & F.col("refers_to").eqNullSafe(F.col("f_id"))
                          & (F.col("payload_digest") == F.col("f_digest")), "left")
    return joined.select(*[c for c in records.columns if c != "payload"], F.coalesce("payload", "f_payload").alias("payload"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = dict(pages.dtypes)["page_id"]
    manifest = write_archives(pages, scratch_path(spark, "warc"))
    records = read_archives(manifest, with_payload=False)
    return records.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast(kind).alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, coalesce(html, '') AS html,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
