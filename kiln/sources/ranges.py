"""Large text files read in byte ranges, each range by the task that gets its descriptor.

A reader lists the files (names and lengths only; folders are listed by tasks), cuts them into ranges of ``split_bytes`` and deals the descriptors
(file, start, stop) out to tasks, which read their bytes themselves. What a range must know of the bytes before it
(its first line's number, whether it begins inside quotes) comes from a first pass that returns one small row a
range, and a prefix over a file's ranges in order. Only descriptors are ever shuffled: no text is exchanged, and no
table grows with the text on the driver or in a broadcast.

A range owns the lines that begin in it: it starts after the first line feed at or after ``start - 1`` and ends
after the first one at or after ``stop - 1``, so neighbours agree without talking to each other. Files are read in
pieces of ``PIECE`` bytes; a task holds a piece, or the longest line or record if that is longer.

Compressed files (gz, bz2, zst, lz4) are one range. Any storage that pyarrow opens will do; for others
``reachable`` is false and the readers take Spark's own sources.
"""

from __future__ import annotations

import os
import re
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT_BYTES = 32 << 20
PIECE = 4 << 20
PACKED = ["gz", "bz2", "zst", "lz4"]
BOM = b"\xef\xbb\xbf"
_END = 1 << 62

_RANGES = "file string, start bigint, stop bigint"


def reachable(spark: SparkSession, path: str) -> bool:
    """Whether tasks can open the files of ``path`` by themselves."""
    found = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/]*))?", path)
    uri = found[0] if found else spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    try:
        fs.FileSystem.from_uri("file:///" if uri.startswith("file:") else uri.rstrip("/") + "/")
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def _encoded(path: str) -> str:
    """A path as it stands in the URIs of Spark's ``_metadata.file_path``."""
    return re.sub(r"[\x00-\x20\"#%<>?\[\\\]^`{|}\x7f]", lambda m: f"%{ord(m[0]):02X}", path)


def _folder(spark: SparkSession, path: str) -> str | None:
    """The URI of ``path`` if it is a folder that tasks can list; None for a file, a pattern or other storage."""
    if re.search(r"[*?{}\[\]\\]", path) or not reachable(spark, path):
        return None
    found = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/]*))?", path)
    uri = found[0] if found else spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/")
    rest = path[found.end():] if found else path
    if uri.startswith("file:"):
        uri, rest = "file:", os.path.abspath(rest)
    elif not rest.startswith("/"):
        return None
    uri = (uri + _encoded(re.sub("/+", "/", rest))).rstrip("/")
    store, root = fs.FileSystem.from_uri(uri)
    return uri if store.get_file_info(root).type == fs.FileType.Directory else None


_LISTED = {"file": pa.string(), "path": pa.string(), "length": pa.int64(), "modificationTime": pa.timestamp("us", tz="UTC")}


def _listed(recursive: bool, whole: bool):
    """What the folders among the rows hold (``whole``: with all below them); rows of files stay. As Spark's readers
    do, it skips hidden and empty files and enters folders of partitions, with ``recursive`` all that are not hidden."""
    def entries(uri):
        store, root = fs.FileSystem.from_uri(uri)
        for info in store.get_file_info(fs.FileSelector(root)):
            name = info.base_name
            if name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name:
                continue
            at = f"{uri}/{_encoded(name)}"
            if info.type == fs.FileType.Directory:
                if recursive or "=" in name:
                    yield at, unquote(at), None, None
            elif info.size:
                yield at, unquote(at), info.size, (info.mtime_ns or 0) // 1_000_000 * 1000

    def run(batches):
        out = []
        for batch in batches:
            out += _descriptors([batch])
            while out:
                rows = [r for r in out if r[2] is not None]
                folders = [r[0] for r in out if r[2] is None]
                if rows:
                    yield _rows(_LISTED, rows)
                out = []
                for i, uri in enumerate(folders):
                    out += entries(uri)
                    if whole and len(out) > 10_000:  # what is found goes on before more is listed
                        out += [(f, None, None, None) for f in folders[i + 1:]]
                        break
                if not whole:
                    if out:
                        yield _rows(_LISTED, out)
                    out = []
    return run


def walk(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file (URI), path, length, modificationTime of every file that Spark's readers would take, no content read.
    Tasks list the folders: two levels one by one, dealt out each time, then what is below each. Nothing but a file's
    row is exchanged, and no list of files grows on the driver."""
    folder = _folder(spark, path)
    if folder is None:
        b = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
        return b.select(F.col("_metadata.file_path").alias("file"), "path", "length", "modificationTime")
    schema = "file string, path string, length bigint, modificationTime timestamp"
    x = spark.range(0, 1, 1, 1).select(F.lit(folder).alias("file"), F.lit(None).cast("string").alias("path"),
                                       F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    for whole in (False, False, True):
        x = x.mapInArrow(_listed(recursive, whole), schema)
        x = x if whole else dealt(x)
    return x


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """file, length of every file that Spark's readers would take; no content is read."""
    return walk(spark, path).select("file", "length")


def _contents(batches):
    held, size = [], 0
    names = ["file", "raw"]

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in held], pa.string()),
                                           pa.array([x for _, x in held], pa.binary()).view(pa.string())], names=names)
    for file, _ in _descriptors(batches):
        with open_at(file) as f:
            held.append((file, f.read()))
        size += len(held[-1][1])
        if size >= PIECE:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def whole_files(files: DataFrame) -> DataFrame:
    """file, raw: the whole text of each of ``files`` (file, length)."""
    return dealt(files.select("file", "length")).mapInArrow(_contents, "file string, raw string")


def dealt(df: DataFrame) -> DataFrame:
    """Descriptors over as many tasks as shuffles have; they are too small for a size to go by."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def byte_ranges(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, start, stop: ranges of at most ``split_bytes``; the last one's stop lies beyond the end of the file."""
    packed = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1)).isin(PACKED)
    n = F.when(packed, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("length") / split_bytes))).cast("bigint")
    one = F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    x = files.select("file", n.alias("n"), one.alias("i"))
    stop = F.when(F.col("i") == F.col("n") - 1, F.lit(_END)).otherwise((F.col("i") + 1) * split_bytes)
    return x.select("file", (F.col("i") * split_bytes).alias("start"), stop.cast("bigint").alias("stop"))


def open_at(uri: str, offset: int = 0):
    """A binary stream of a file from ``offset`` on, decompressed where its suffix says so."""
    store, path = fs.FileSystem.from_uri(uri)
    if path.rsplit(".", 1)[-1].lower() in PACKED:
        return store.open_input_stream(path, compression="detect")
    f = store.open_input_file(path)
    f.seek(offset)
    return f


def aligned_pieces(uri: str, start: int, stop: int, piece: int | None = None):
    """The bytes of the lines that begin in the range, in pieces that end after a line feed (or the file does)."""
    piece = piece or PIECE
    at = max(start - 1, 0)
    with open_at(uri, at) as f:
        held, started = b"", start == 0
        while True:
            data = f.read(piece)
            if not started:
                i = data.find(b"\n")
                if not data or i < 0 and at + len(data) >= stop or i >= 0 and at + i + 1 >= stop:
                    return
                if i < 0:
                    at += len(data)
                    continue
                at, data, started = at + i + 1, data[i + 1:] or f.read(piece), True
            elif at == 0 and not held and data.startswith(BOM):
                at, data = len(BOM), data[len(BOM):]
            held += data
            if at + len(held) >= stop:
                i = held.find(b"\n", max(stop - 1 - at, 0))
                if i >= 0:
                    yield held[:i + 1]
                    return
            if not data:
                if held:
                    yield held
                return
            cut = held.rfind(b"\n") + 1 or held.rfind(b"\r", 0, len(held) - 1) + 1
            if cut:
                yield held[:cut]
                held, at = held[cut:], at + cut


def line_array(block: bytes) -> pa.Array:
    """The lines of a block as strings, without their ends (line feed, carriage return or both)."""
    if b"\r" in block:
        block = block.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    if not block.endswith(b"\n"):
        block += b"\n"
    raw = np.frombuffer(block, dtype=np.uint8)
    feed = raw == 10
    ends = np.flatnonzero(feed)
    offsets = np.zeros(len(ends) + 1, dtype=np.int32)
    offsets[1:] = ends - np.arange(len(ends))
    return pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~feed].tobytes())])


def _descriptors(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _rows(kinds: dict, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def with_prefix(ranges: DataFrame, values: str, total) -> DataFrame:
    """``ranges`` with ``total`` over the rows of the ranges before each in its file."""
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn(values, total.over(before))


def composed(ranges: DataFrame, after_out, after_in) -> DataFrame:
    """``ranges`` with ``inside``: whether a file is inside at the range's start, being outside at its own. Each range
    is a function of one truth value: it keeps it, turns it, or ends alike whatever it was. So the value before a
    range is that of the last range that forgets, turned as often as ranges turn after it."""
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    x = ranges.withColumn("_turns", F.sum(F.when(after_out & ~after_in, 1).otherwise(0)).over(order))
    last = F.last(F.when(after_out == after_in, F.struct(after_out.cast("int").alias("value"), "_turns")), ignorenulls=True)
    x = x.withColumns({"_last": last.over(before), "_so_far": F.lag("_turns", 1, 0).over(order)})
    turned = F.coalesce(F.col("_last.value"), F.lit(0)) + F.col("_so_far") - F.coalesce(F.col("_last._turns"), F.lit(0))
    return x.withColumn("inside", turned % 2 == 1).drop("_turns", "_last", "_so_far")


# ------------------------------------------------------------ lines

def _count_lines(batches):
    kinds = {"file": pa.string(), "start": pa.int64(), "stop": pa.int64(), "n": pa.int64()}
    for file, start, stop in _descriptors(batches):
        # a file of one range needs no count
        n = 0 if start == 0 and stop == _END else sum(len(line_array(b)) for b in aligned_pieces(file, start, stop))
        yield _rows(kinds, [(file, start, stop, n)])


def _number_lines(batches):
    for file, start, stop, before in _descriptors(batches):
        for block in aligned_pieces(file, start, stop):
            lines = line_array(block)
            numbers = pa.array(np.arange(before + 1, before + 1 + len(lines)))
            before += len(lines)
            yield pa.RecordBatch.from_arrays([pa.repeat(file, len(lines)), numbers, lines], names=["file", "line_no", "line"])


def ranged_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, line_no, line of all text files of ``path``; lines end as in ``line_array``."""
    counted = dealt(byte_ranges(list_files(spark, path), split_bytes)).mapInArrow(_count_lines, f"{_RANGES}, n bigint")
    known = with_prefix(counted, "before", F.sum("n")).select("file", "start", "stop", F.coalesce("before", F.lit(0)).alias("before"))
    return dealt(known).mapInArrow(_number_lines, "file string, line_no bigint, line string")


# ------------------------------------------------------------ heads

def _heads(n_bytes: int):
    kinds = {"file": pa.string(), "length": pa.int64(), "head": pa.binary()}

    def run(batches):
        for file, length in _descriptors(batches):
            with open_at(file) as f:
                yield _rows(kinds, [(file, length, f.read(n_bytes))])
    return run


def file_heads(spark: SparkSession, path: str, n_bytes: int = 4096) -> DataFrame:
    """file, length, head: the first ``n_bytes`` bytes of each file; nothing else of it is read."""
    return dealt(list_files(spark, path)).mapInArrow(_heads(n_bytes), "file string, length bigint, head binary")


def _first_lines(batches):
    kinds = {"file": pa.string(), "line_no": pa.int64(), "line": pa.string()}
    for file, _ in _descriptors(batches):
        n = 0
        for block in aligned_pieces(file, 0, _END, piece=1 << 14):
            lines = line_array(block).cast(pa.binary()).to_pylist()
            found = next((i for i, x in enumerate(lines) if x.decode("utf-8", "replace").strip()), None)
            if found is not None:
                yield _rows(kinds, [(file, n + found + 1, lines[found].decode("utf-8", "replace"))])
                break
            n += len(lines)


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line: the first line of each file that is not blank; reading stops there."""
    return dealt(list_files(spark, path)).mapInArrow(_first_lines, "file string, line_no bigint, line string")


# ------------------------------------------------------------ delimited text

def _patterns(sep: str):
    """What closes an open quoted field, and a whole quoted field; its second group is empty where it stays open."""
    s = re.escape(sep.encode())
    inner = rb'[^"]*(?:""[^"]*)*'
    return re.compile(inner + rb'"(?!")'), re.compile(rb'(?:(?<=[\r\n' + s + rb'])|\A)"' + inner + rb'("(?!")|\Z)')


def quoted_spans(block: bytes, inside: bool, patterns) -> tuple[list[tuple[int, int]], bool]:
    """The stretches of ``block`` within quotes (a quote counts at the start of a field; doubled ones are text), and
    whether its end is within one. ``inside``: its start is."""
    if b'"' not in block:
        return ([(0, len(block))] if inside else []), inside
    closes, field = patterns
    spans, at = [], 0
    if inside:
        m = closes.match(block)
        if not m:
            return [(0, len(block))], True
        spans.append((0, m.end()))
        at = m.end()
    for m in field.finditer(block, at):
        spans.append(m.span())
        if not m[1]:
            return spans, True
    return spans, False


def _record_ends(block: bytes, spans: list[tuple[int, int]]) -> np.ndarray:
    """Places after the line ends of ``block`` that no span covers."""
    raw = np.frombuffer(block, dtype=np.uint8)
    ends = raw == 10
    if b"\r" in block:
        alone = raw == 13
        alone[:-1] &= raw[1:] != 10
        ends |= alone
    at = np.flatnonzero(ends)
    if spans and len(at):
        first, last = np.array(spans).T
        i = np.searchsorted(first, at, side="right") - 1
        at = at[(i < 0) | (at >= last[np.maximum(i, 0)])]
    return at + 1


def _quote_states(sep: str):
    kinds = {"file": pa.string(), "start": pa.int64(), "stop": pa.int64(), "after_out": pa.bool_(), "after_in": pa.bool_()}

    def run(batches):
        patterns = _patterns(sep)
        for file, start, stop in _descriptors(batches):
            out, within = False, True
            if stop != _END:  # no range needs to know the state after a file's last one
                for block in aligned_pieces(file, start, stop):
                    same = out == within
                    out = quoted_spans(block, out, patterns)[1]
                    within = out if same else quoted_spans(block, within, patterns)[1]
            yield _rows(kinds, [(file, start, stop, out, within)])
    return run


def _records_of(file: str, start: int, stop: int, inside: bool, patterns):
    """Lists of the records (bytes) that begin in a range; the last is read to its end, beyond the range if need be."""
    held = b""
    for block in aligned_pieces(file, start, stop):
        block = held + block
        spans, after = quoted_spans(block, inside, patterns)
        ends = _record_ends(block, spans).tolist()
        first = 0
        if inside:  # an earlier range's record
            if not ends:
                inside = after
                continue
            first, inside = ends.pop(0), False
        yield [block[a:b].rstrip(b"\r\n") for a, b in zip([first, *ends], ends)]
        held = block[ends[-1] if ends else first:]
    if held and stop != _END:
        for block in aligned_pieces(file, stop, _END):
            held += block
            ends = _record_ends(held, quoted_spans(held, False, patterns)[0])
            if len(ends):
                held = held[:ends[0]]
                break
    if held:
        yield [held.rstrip(b"\r\n")]


def _delimited(sep: str):
    def run(batches):
        patterns = _patterns(sep)
        for file, start, stop, inside in _descriptors(batches):
            header = start == 0
            for records in _records_of(file, start, stop, inside, patterns):
                records = [r for r in records if r]
                if header and records:
                    records, header = records[1:], False
                if records:
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(file, len(records)), pa.array(records, pa.binary()).view(pa.string())], names=["file", "record"])
    return run


def ranged_records(spark: SparkSession, path: str, sep: str = ",", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """file, record: the records of delimited files without their header, as text; a record may hold line breaks
    within quotes and lie across ranges.

    The first pass finds, for a range that begins outside quotes and for one that begins inside, whether its end is
    inside; the prefix composes these functions over the ranges of a file."""
    states = dealt(byte_ranges(list_files(spark, path), split_bytes)).mapInArrow(
        _quote_states(sep), f"{_RANGES}, after_out boolean, after_in boolean")
    known = composed(states, F.col("after_out"), F.col("after_in"))
    return dealt(known.select("file", "start", "stop", "inside")).mapInArrow(_delimited(sep), "file string, record string")
