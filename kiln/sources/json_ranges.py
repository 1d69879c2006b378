"""One large JSON document, read by many tasks.

The file is cut into byte ranges. A first pass counts, in each range, the quotes that are not escaped and the change
of bracket depth for both cases, that the range begins inside a string or not; prefixes over the ranges give each one
the state it begins in. A second pass finds the lists that can hold the records (the document itself, or the values
of a top-level object), where they begin and end and how many separators each range has of them; a prefix numbers
the records. Then each range reads the records that begin in it, the last one beyond its end. Only descriptors and
these small rows are shuffled; a task holds a piece of its range, or the longest record.

Documents whose brackets or quotes do not close, or that hold more than one top-level value, give no rows. A document
without such a list is one record and read by one task. Where an object repeats a name, ``envelope`` takes its last
list; the first list is the first in the text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.sources import ranges

_OPEN_LIST, _OPEN, _CLOSE_LIST, _CLOSE, _COMMA, _QUOTE, _ESCAPE = range(1, 8)
_SIGNS = np.zeros(256, dtype=np.uint8)
_SIGNS[list(b'[{]},"\\')] = range(1, 8)
_DEPTH = np.array([0, 1, 1, -1, -1, 0, 0, 0])
_BACK = 1 << 16


class Scanner:
    """Follows strings and brackets through the bytes it is fed."""

    def __init__(self, inside: bool = False, escaped: bool = False, depth: int = 0):
        self.inside, self.escaped, self.depth = inside, escaped, depth

    def feed(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Places, kinds and depths (after each) of the brackets and commas outside strings; the number of quotes
        that are not escaped."""
        raw = np.frombuffer(data, dtype=np.uint8)
        signs = _SIGNS[raw]
        at = np.flatnonzero(signs)
        kind = signs[at]
        real = kind == _QUOTE
        slashes = at[kind == _ESCAPE]
        if len(slashes):
            ends = np.flatnonzero(np.diff(slashes, append=-1) != 1)
            length = np.diff(ends, prepend=-1)
            last = slashes[ends]  # where runs of backslashes end
            if self.escaped and slashes[0] == 0:
                length[0] += 1
            run = np.minimum(np.searchsorted(last, at - 1), len(last) - 1)
            real &= ~((last[run] == at - 1) & (length[run] % 2 == 1))
        if self.escaped and len(raw) and raw[0] == 34:
            real[0] = False
        if len(raw):
            self.escaped = bool(len(slashes) and last[-1] == len(raw) - 1 and length[-1] % 2 == 1)
        within = (int(self.inside) + np.cumsum(real) - real) % 2 == 1
        quotes = int(real.sum())
        self.inside ^= quotes % 2 == 1
        keep = ~within & (kind <= _COMMA)
        at, kind = at[keep], kind[keep]
        depth = self.depth + np.cumsum(_DEPTH[kind])
        if len(depth):
            self.depth = int(depth[-1])
        return at, kind, depth, quotes


def _escaped_before(f, start: int) -> bool:
    """Whether an odd run of backslashes ends right before ``start``."""
    n, at = 0, start
    while at > 0:
        a = max(0, at - _BACK)
        f.seek(a)
        data = f.read(at - a)
        run = len(data) - len(data.rstrip(b"\\"))
        n += run
        if run < len(data):
            break
        at = a
    return n % 2 == 1


def _pieces(file: str, start: int, stop: int):
    """The bytes of a range, piece by piece, with the offset of each; first whether its first byte is escaped."""
    with ranges.open_at(file) as f:
        if start:
            escaped = _escaped_before(f, start)
            f.seek(start)
        else:
            escaped = False
        yield escaped
        at = start
        while at < stop:
            data = f.read(min(ranges.PIECE, stop - at))
            if not data:
                return
            if at == 0 and data.startswith(ranges.BOM):
                data = b"   " + data[3:]
            yield at, data
            at += len(data)


_STATE = {"file": pa.string(), "start": pa.int64(), "stop": pa.int64(), "odd": pa.bool_(), "deeper_out": pa.int64(),
          "deeper_in": pa.int64(), "kind": pa.string()}


def _states(batches):
    for file, start, stop in ranges._descriptors(batches):
        pieces = _pieces(file, start, stop)
        escaped = next(pieces)
        out, within = Scanner(False, escaped), Scanner(True, escaped)
        quotes, kind = 0, None
        for _, data in pieces:
            quotes += out.feed(data)[3]
            within.feed(data)
            if start == 0 and not kind and data.strip():
                kind = {b"[": "list", b"{": "object"}.get(data.strip()[:1], "value")
        yield ranges._rows(_STATE, [(file, start, stop, quotes % 2 == 1, out.depth, within.depth, kind)])


def _key_before(file: str, offset: int) -> str | None:
    """The member name whose value begins at ``offset``."""
    size = _BACK
    with ranges.open_at(file) as f:
        while True:
            a = max(0, offset - size)
            f.seek(a)
            head = f.read(offset - a).rstrip()
            if not head.endswith(b":"):
                return None
            head = head[:-1].rstrip()
            i = len(head) - 1
            while (i := head.rfind(b'"', 0, i)) >= 0:  # the nearest quote that is not escaped
                before = head[:i]
                if (len(before) - len(before.rstrip(b"\\"))) % 2 == 0:
                    return json.loads(head[i:].decode("utf-8", "replace"), strict=False)
            if a == 0:
                return None
            size *= 4


_LISTS = {"file": pa.string(), "start": pa.int64(), "stop": pa.int64(), "inside": pa.bool_(), "depth": pa.int64(),
          "level": pa.int64(), "at": pa.int64(), "begin": pa.int64(), "key": pa.string(), "end": pa.int64(), "marks": pa.int64(),
          "tops": pa.int64()}


def _lists(batches):
    """For each range and list that could hold the records: where it begins and ends, if it does so in the range,
    and how many of its records begin there. A further row a range has the top-level values that end there."""
    for file, start, stop, inside, depth, level in ranges._descriptors(batches):
        pieces = _pieces(file, start, stop)
        scan = Scanner(inside, next(pieces), depth)
        # a list may be open already; it is known by the earlier range that has its beginning
        now = {"at": start, "begin": None, "key": None, "end": None, "marks": 0} if depth > level else None
        done, tops = [], 0
        for offset, data in pieces:
            at, kind, after, _ = scan.feed(data)
            tops += int((((kind == _CLOSE_LIST) | (kind == _CLOSE)) & (after == 0)).sum())
            turns = ((kind == _OPEN_LIST) & (after == level + 1)) | ((kind == _CLOSE_LIST) & (after == level))
            marks = (kind == _COMMA) & (after == level + 1)
            last = 0
            for i in np.flatnonzero(turns):
                if now:
                    now["marks"] += int(marks[last:i].sum())
                last = i
                place = offset + int(at[i])
                if kind[i] == _OPEN_LIST:
                    now = {"at": place, "begin": place, "key": _key_before(file, place) if level else None, "end": None, "marks": 1}
                elif now:
                    now["end"] = place
                    done.append(now)
                    now = None
            if now:
                now["marks"] += int(marks[last:].sum())
        if now:
            done.append(now)
        yield ranges._rows(_LISTS, [(file, start, stop, inside, depth, level, *d.values(), None) for d in done] + [
            (file, start, stop, inside, depth, level, start, None, None, None, 0, tops)])


def _records(batches):
    """The records that begin in a range, between the beginning and the end of their list."""
    kinds = {"file": pa.string(), "pos": pa.int64(), "raw": pa.string(), "whole": pa.bool_()}
    for file, start, stop, inside, depth, level, begin, end, before in ranges._descriptors(batches):
        if begin is None:
            with ranges.open_at(file) as f:
                yield ranges._rows(kinds, [(file, 0, f.read().removeprefix(ranges.BOM).decode("utf-8", "replace"), True)])
            continue
        pieces = _pieces(file, start, end + 1)
        scan = Scanner(inside, next(pieces), depth)
        held, held_at, rows, size = None, 0, [], 0
        for offset, data in pieces:
            at, kind, after, _ = scan.feed(data)
            cuts = at[((kind == _COMMA) & (after == level + 1) & (at + offset > begin)) | (at + offset == begin) | (at + offset == end)]
            last = 0
            for c in cuts.tolist():
                place = offset + c
                if held is not None:
                    raw = (b"".join(held) + data[last:c]).strip()
                    if raw:
                        rows.append((file, before, raw.decode("utf-8", "replace"), False))
                        size += len(raw)
                    before += 1
                held, last = [], c + 1
                if place == end or place >= stop:
                    held = None
                    break
            if size >= ranges.PIECE:
                yield ranges._rows(kinds, rows)
                rows, size = [], 0
            if held is None:
                if offset + len(data) >= stop or (len(cuts) and offset + int(cuts[-1]) == end):
                    break
            else:
                held.append(data[last:])
        if rows:
            yield ranges._rows(kinds, rows)


def ranged_json(files: DataFrame, envelope: list[str] | None = None, split_bytes: int = ranges.SPLIT_BYTES) -> DataFrame:
    """file, pos, raw (JSON text of a record), whole (the record is the whole document) of the documents in ``files``
    (file, length). Records are the elements of a top-level list; of an object, those of its first member that is a
    list, or with ``envelope`` of the first of these names that has a list."""
    parts = ranges.dealt(ranges.byte_ranges(files, split_bytes)).mapInArrow(
        _states, "file string, start bigint, stop bigint, odd boolean, deeper_out bigint, deeper_in bigint, kind string")
    order, whole = Window.partitionBy("file").orderBy("start"), Window.partitionBy("file")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    odd = F.col("odd").cast("int")
    known = parts.withColumns({"inside": F.coalesce(F.sum(odd).over(before), F.lit(0)) % 2 == 1,
                               "odd_file": F.sum(odd).over(whole) % 2 == 1, "kind": F.max("kind").over(whole)})
    deeper = F.when(F.col("inside"), F.col("deeper_in")).otherwise(F.col("deeper_out"))
    known = known.withColumns({"depth": F.coalesce(F.sum(deeper).over(before), F.lit(0)), "last": F.sum(deeper).over(whole)})
    level = F.when(F.col("kind") == "list", 0).when(F.col("kind") == "object", 1).otherwise(1 << 40).cast("bigint")
    known = known.where(~F.col("odd_file") & (F.col("last") == 0) & F.col("kind").isNotNull()).withColumn("level", level)
    lists = ranges.dealt(known.select("file", "start", "stop", "inside", "depth", "level")).mapInArrow(
        _lists, "file string, start bigint, stop bigint, inside boolean, depth bigint, level bigint, at bigint, begin bigint, "
                "key string, end bigint, marks bigint, tops bigint")
    along = Window.partitionBy("file").orderBy("at", F.col("tops").isNull())
    named = lists.withColumn("list", F.last("begin", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("file", "list")
    rank = F.lit(0)
    if envelope is not None:
        rank = F.coalesce(*[F.when(F.col("key") == k, F.lit(i)) for i, k in enumerate(envelope)])
    rank = F.when(F.col("level") == 0, 0).otherwise(rank)
    by = F.col("begin") * (1 if envelope is None else -1)
    wanted = F.when(F.col("begin").isNotNull() & rank.isNotNull(), F.struct(rank.alias("rank"), by.alias("by"), F.col("begin")))
    named = named.withColumns({
        "chosen": F.min(wanted).over(whole)["begin"], "end": F.max("end").over(own), "all_tops": F.sum("tops").over(whole),
        "before": F.coalesce(F.sum("marks").over(own.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    listed = F.col("tops").isNull() & (F.col("list") == F.col("chosen")) & F.col("end").isNotNull()
    alone = F.col("tops").isNotNull() & (F.col("start") == 0) & F.col("chosen").isNull()
    read = named.where((F.col("all_tops") == F.when(F.col("level") > 1, 0).otherwise(1)) & (listed | alone)).select(
        "file", "start", "stop", "inside", "depth", "level", F.when(listed, F.col("list")).alias("begin"), "end", "before")
    return ranges.dealt(read).mapInArrow(_records, "file string, pos bigint, raw string, whole boolean")
