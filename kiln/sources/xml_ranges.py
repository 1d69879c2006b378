"""The children of an XML document's root, counted in byte ranges, and the elements of one name, cut out as records.

Ranges are cut before a ``<``, which stands in no tag, so what a range must know is whether it begins in content, in a
comment or in a CDATA section, and how deep. A first pass follows each range from all three states (a small row a
range); a fold over a file's rows gives each range its state and depth, and a second pass counts the tags that open
one level below the root. No task holds more than a piece of a file, or its longest tag or text.
"""

from __future__ import annotations

import re
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.sources import ranges

_CONTENT, _COMMENT, _CDATA = range(3)
_ENDS = {_COMMENT: b"-->", _CDATA: b"]]>"}
_TOKEN = re.compile(
    rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>|(<!--|<!\[CDATA\[)"
    rb"|<(/?)([A-Za-z_\x80-\xff][\w.\-:\x80-\xff]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
_ATTRIBUTE = re.compile(rb"([^\s=]+)\s*=\s*(?:\"[^\"]*\"|'[^']*')")


def tag_pieces(uri: str, start: int, stop: int):
    """Offset and bytes from the first ``<`` at or after ``start`` (or the file's beginning) to the first one at or
    after ``stop``, in pieces that end before a ``<``."""
    with ranges.open_at(uri, start) as f:
        at, held, started = start, b"", start == 0
        while True:
            data = f.read(ranges.PIECE)
            if not started:
                i = data.find(b"<")
                if not data or i < 0 and at + len(data) >= stop or i >= 0 and at + i >= stop:
                    return
                if i < 0:
                    at += len(data)
                    continue
                at, data, started = at + i, data[i:], True
            held += data
            if at + len(held) > stop:
                i = held.find(b"<", max(stop - at, 0))
                if i >= 0:
                    yield at, held[:i]
                    return
            if not data:
                if held:
                    yield at, held
                return
            cut = held.rfind(b"<")
            if cut > 0:
                yield at, held[:cut]
                at, held = at + cut, held[cut:]


def follow(data: bytes, state: int, depth: int, child=None, each=None) -> tuple[int, int]:
    """State and depth after ``data``; ``child(place, tag, attributes)`` is called for each tag that opens at depth 1,
    ``each(start, stop, tag, change of depth)`` for every tag."""
    at = 0
    if state != _CONTENT:
        i = data.find(_ENDS[state])
        if i < 0:
            return state, depth
        at = i + 3
    for m in _TOKEN.finditer(data, at):
        left_open, closing, tag, attributes, empty = m.groups()
        if left_open:
            return (_COMMENT if left_open == b"<!--" else _CDATA), depth
        if not tag:
            continue
        if each:
            each(m.start(), m.end(), tag, -1 if closing else 0 if empty else 1)
        if closing:
            depth -= 1
            continue
        if child and depth == 1:
            child(m.start(), tag, attributes)
        depth += not empty
    return _CONTENT, depth


_STATES = "file string, start bigint, stop bigint, ends array<int>, deeper array<bigint>, within array<bigint>"


def _states(row_tag: bytes | None = None):
    """For each range and state it may begin in: its state at the end, the change of depth, and that of the depth of
    ``row_tag`` in itself."""
    kinds = {"file": pa.string(), "start": pa.int64(), "stop": pa.int64(), "ends": pa.list_(pa.int32()),
             "deeper": pa.list_(pa.int64()), "within": pa.list_(pa.int64())}

    def run(batches):
        for file, start, stop in ranges._descriptors(batches):
            now, within = [(state, 0) for state in (_CONTENT, _COMMENT, _CDATA)], [0, 0, 0]
            if stop != ranges._END:
                for _, data in tag_pieces(file, start, stop):
                    for i, (state, depth) in enumerate(now):
                        def each(_, __, tag, change, i=i):
                            if tag == row_tag:
                                within[i] += change
                        now[i] = follow(data, state, depth, each=each if row_tag else None)
            yield ranges._rows(kinds, [(file, start, stop, [s for s, _ in now], [d for _, d in now], within)])
    return run


def _fold(batches):
    """State, depth and depth of the row element that each range begins in; a file's ranges come in order."""
    file = None
    for rows in batches:
        out = []
        for name, ends, deeper, inner in zip(rows["file"], rows["ends"], rows["deeper"], rows["within"]):
            if name != file:
                file, state, depth, within = name, _CONTENT, 0, 0
            out.append((state, depth, within))
            state, depth, within = int(ends[state]), depth + int(deeper[state]), within + int(inner[state])
        yield rows[["file", "start", "stop"]].assign(**{c: [r[i] for r in out] for i, c in enumerate(("state", "depth", "within"))})


def _known(spark: SparkSession, path: str, split_bytes: int, row_tag: bytes | None = None) -> DataFrame:
    """file, start, stop, state, depth, within: the ranges of all files with what they begin in, dealt out."""
    parts = ranges.dealt(ranges.byte_ranges(ranges.list_files(spark, path), split_bytes))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    states = parts.mapInArrow(_states(row_tag), _STATES).repartition(n, "file").sortWithinPartitions("file", "start")
    return ranges.dealt(states.mapInPandas(_fold, "file string, start bigint, stop bigint, state int, depth bigint, within bigint"))


_TAGS = {"file": pa.string(), "tag": pa.string(), "n": pa.int64(), "first_at": pa.int64(), "attributes": pa.list_(pa.string())}


def _count_tags(batches):
    for file, start, stop, state, depth, _ in ranges._descriptors(batches):
        found: dict = {}
        for offset, data in tag_pieces(file, start, stop):
            def child(place, tag, attributes, offset=offset):
                if tag not in found:
                    found[tag] = [0, offset + place, [a.decode("utf-8", "replace") for a in _ATTRIBUTE.findall(attributes)]]
                found[tag][0] += 1
            state, depth = follow(data, state, depth, child)
        yield ranges._rows(_TAGS, [(file, tag.decode("utf-8", "replace"), *x) for tag, x in found.items()])


def child_tags(spark: SparkSession, path: str, split_bytes: int = ranges.SPLIT_BYTES) -> DataFrame:
    """file, tag, n, first_at, attributes (names, of the first one) of the tags directly below each root."""
    found = _known(spark, path, split_bytes).mapInArrow(
        _count_tags, "file string, tag string, n bigint, first_at bigint, attributes array<string>")
    return found.groupBy("file", "tag").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"),
                                            F.min_by("attributes", "first_at").alias("attributes"))


def _rows_of(file: str, start: int, stop: int, state: int, within: int, row_tag: bytes):
    """Lists of the row elements (bytes) that begin in a range and in no other one; the last is read to its end,
    beyond the range if need be."""
    beyond = tag_pieces(file, stop, ranges._END) if stop != ranges._END else ()
    held, at, out = None, 0, []

    def each(first, last, tag, change):
        nonlocal held, at, within
        if tag != row_tag:
            return
        if not within and own and change >= 0:
            held, at = [], first
        within = max(within + change, 0)
        if not within and held is not None:
            out.append(b"".join(held) + data[at:last])
            held = None

    for own, (_, data) in chain(((True, p) for p in tag_pieces(file, start, stop)), ((False, p) for p in beyond)):
        if not own and held is None:
            break
        state, _ = follow(data, state, 0, each=each)
        if held is not None:
            held.append(data[at:])
            at = 0
        if out:
            yield out
            out = []
    if held is not None:
        yield [b"".join(held)]


def _cut_records(row_tag: bytes):
    def run(batches):
        for file, start, stop, state, _, within in ranges._descriptors(batches):
            for rows in _rows_of(file, start, stop, state, within, row_tag):
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(file, len(rows)), pa.array(rows, pa.binary()).view(pa.string())], names=["file", "record"])
    return run


def records(spark: SparkSession, path: str, row_tag: str, split_bytes: int = ranges.SPLIT_BYTES) -> DataFrame:
    """file, record: the text of each outermost element named ``row_tag``, at any depth."""
    tag = row_tag.encode()
    return _known(spark, path, split_bytes, tag).mapInArrow(_cut_records(tag), "file string, record string")
