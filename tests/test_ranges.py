"""Files read in byte ranges: the same rows as from the whole file, and no text in an exchange."""

import json
import os
import random

import pytest

from kiln.sources import files as S
from kiln.sources import json_ranges, ranges


def put(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)


def exchanges_after_text(df):
    """Exchanges above the reader: what it returns would go through them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[:plan.index("MapInArrow")].count("Exchange")


# ------------------------------------------------------------ lines

LINES = [b"", b"one", b"one\n", b"a\nb\r\nc\rd\n\n\ne", b"\xef\xbb\xbfbom\nx", b"\r\r\n\n", b"x" * 500 + b"\n" + b"y" * 300,
         "é中\n文".encode(), b"\n".join(b"line %d" % i for i in range(400)), b"bad \xff\xfe bytes\nok\n"]


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_lines_of_every_range_once(tmpdir_fresh, split, monkeypatch):
    monkeypatch.setattr(ranges, "PIECE", 11)
    for n, data in enumerate(LINES):
        put(tmpdir_fresh, f"{n}.txt", data)
        uri, stops = f"file://{tmpdir_fresh}/{n}.txt", [*range(split, len(data), split), ranges._END]
        got = [x for a, b in zip([0, *stops], stops) for block in ranges.aligned_pieces(uri, a, b)
               for x in ranges.line_array(block).cast("binary").to_pylist()]
        text = data.removeprefix(ranges.BOM).decode("utf-8", "surrogateescape")
        want = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        assert got == [x.encode("utf-8", "surrogateescape") for x in (want[:-1] if want[-1] == "" else want)], (n, split)


def test_line_numbers_across_ranges(spark, tmpdir_fresh):
    for n, data in enumerate(LINES):
        put(tmpdir_fresh, f"{n}.txt", data)
    one = sorted(tuple(r) for r in ranges.ranged_lines(spark, tmpdir_fresh, split_bytes=50).collect())
    whole = sorted(tuple(r) for r in S.read_lines(spark, tmpdir_fresh).collect())
    plain = sorted(tuple(r) for r in S.numbered_lines(spark.read.text(tmpdir_fresh)).collect())
    assert one == whole == plain and len(one) > 400
    df = ranges.ranged_lines(spark, tmpdir_fresh)
    df.collect()
    assert exchanges_after_text(df) == 0


def test_packed_files_are_one_range(spark, tmpdir_fresh):
    import gzip
    put(tmpdir_fresh, "a.txt.gz", gzip.compress(b"".join(b"%d\n" % i for i in range(5_000))))
    got = [(r.line_no, r.line) for r in ranges.ranged_lines(spark, tmpdir_fresh, split_bytes=100).orderBy("line_no").collect()]
    assert got == [(i + 1, str(i)) for i in range(5_000)]


# ------------------------------------------------------------ heads

def test_heads_and_first_lines(spark, tmpdir_fresh):
    put(tmpdir_fresh, "a.csv", b"id,v\n" + b"".join(b"%d,x\n" % i for i in range(5_000)))
    put(tmpdir_fresh, "b.csv", b"no line end")
    put(tmpdir_fresh, "c.csv", b"")
    put(tmpdir_fresh, "d.csv", b"\n  \n\xc2\xa0\n" + b"\n" * 40_000 + b" [1]\n{}")
    got = {os.path.basename(r.file): r.rows for r in S.estimate_csv_rows(spark, tmpdir_fresh).collect()}
    size, head = os.path.getsize(f"{tmpdir_fresh}/a.csv"), open(f"{tmpdir_fresh}/a.csv", "rb").read(4096)
    assert got == {"a.csv": int(size / (4096 / head.count(b"\n"))), "b.csv": 1,
                   "d.csv": int(os.path.getsize(f"{tmpdir_fresh}/d.csv") / (4096 / open(f"{tmpdir_fresh}/d.csv", "rb").read(4096).count(b"\n")))}
    got = {os.path.basename(r.file): r.format for r in S.sniff_files(spark, tmpdir_fresh).collect()}
    assert got == {"a.csv": "csv", "b.csv": "text", "d.csv": "json"}


# ------------------------------------------------------------ delimited text

def random_csv(rng, rows, sep):
    def field():
        t = "".join(rng.choice(["a", "b", sep, " ", "\n", '"', "é", "xyz", '""', "'"]) for _ in range(rng.randrange(12)))
        if rng.random() < 0.1:
            return 'st"ray'
        return t if not any(c in t for c in sep + '"\n') and rng.random() < 0.5 else '"' + t.replace('"', '""') + '"'
    out = [sep.join(["x", "y", "z"]) + "\n"]
    for i in range(rows):
        out.append(sep.join([str(i)] + [field() for _ in range(rng.choice([2, 2, 2, 1, 3]))]) + rng.choice(["\n", "\n", "\n\n"]))
    return "".join(out).encode()


@pytest.mark.parametrize("sep", [",", "\t"])
def test_quoted_csv_is_split(spark, tmpdir_fresh, sep, monkeypatch):
    rng = random.Random(ord(sep))
    for n in range(3):
        put(tmpdir_fresh, f"{n}.csv", random_csv(rng, 300, sep))
    put(tmpdir_fresh, "long.csv", b"x" + sep.encode() + b"y\n1" + sep.encode() + b'"' + b"line\n" * 2_000 + b'"\n2' + sep.encode() + b"end")
    df = S.read_delimited(spark, tmpdir_fresh, sep, header_cols=["x", "y", "z"], split_bytes=101)
    got = sorted(map(str, df.collect()))
    assert exchanges_after_text(df) == 0
    monkeypatch.setattr(ranges, "reachable", lambda *a: False)
    assert got == sorted(map(str, S.read_delimited(spark, tmpdir_fresh, sep, header_cols=["x", "y", "z"]).collect()))
    assert len(got) > 700


def test_a_record_spans_ranges_and_many_tasks_read(spark, tmpdir_fresh):
    put(tmpdir_fresh, "a.csv", b"k,v\n" + b"".join(b'%d,"%s"\r\n' % (i, b"q\n" * (i % 50)) for i in range(2_000)))
    files = ranges.list_files(spark, tmpdir_fresh)
    assert ranges.byte_ranges(files, 1_000).count() > 50
    df = S.read_delimited(spark, tmpdir_fresh, split_bytes=1_000)
    got = {int(r.k): r.v for r in df.collect()}
    assert got == {i: "q\n" * (i % 50) or None for i in range(2_000)}


def test_composed_states(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for f in range(20):
        state = False
        for i in range(30):
            out, within = rng.choice([(False, True), (False, True), (True, False), (False, False), (True, True)])
            rows.append((str(f), i, out, within))
            want[str(f), i] = state
            state = within if state else out
    df = spark.createDataFrame(rows, "file string, start bigint, after_out boolean, after_in boolean")
    got = {(r.file, r.start): r.inside for r in ranges.composed(df, df.after_out, df.after_in).collect()}
    assert got == want


# ------------------------------------------------------------ JSON documents

def value(rng, depth=0):
    k = rng.randrange(8)
    if k == 0 and depth < 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if k == 1 and depth < 3:
        return {rng.choice(["a", 'b"', "data", "c\\"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}
    return rng.choice(["", "x\\", '"q"', '\\"[', "]}{", "é中", 1, 2.5, None, True, "\\\\\\", ",,,"])


def test_json_documents_are_split(spark, tmpdir_fresh):
    rng = random.Random(1)
    for i in range(60):
        recs = [value(rng) for _ in range(rng.randrange(30))]
        doc = [recs, {"v": 1, "rows": recs, "data": [1]}, {"other": {"data": [3]}, "samples": recs, "data": rng.choice([5, [7, 8]])},
               {"only": "x", "n": {"rows": [1]}}, recs, {"items": [], "rows": recs}, "scalar"][rng.randrange(7)]
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 2]))
        put(tmpdir_fresh, f"{i}.json", (" \n" + text[:-1 if i % 20 == 7 else None] + "\n").encode())
    put(tmpdir_fresh, "empty.json", b"")
    put(tmpdir_fresh, "bom.json", b'\xef\xbb\xbf{"data":[1,2,{"a":[3]}]}')

    def rows(df):
        return sorted((os.path.basename(r.file), r.pos, r.rec.toJson()) for r in df.collect())
    for rule in ("first_list", "envelope"):
        got = rows(S.read_json_doc(spark, tmpdir_fresh, rule, split_bytes=23))
        assert ("bom.json", 2, '{"a":[3]}') in got
        assert [r for r in got if r[0] != "bom.json"] == [r for r in rows(S.read_json_doc(spark, tmpdir_fresh, rule)) if r[0] != "bom.json"]
        assert len(got) > 250


def test_json_documents_that_are_not_one_value(spark, tmpdir_fresh):
    for i, text in enumerate(["[1,2][3]", '{"data":[1]} {"data":[2]}', "[1,2", '["a]', "[1]]"]):
        put(tmpdir_fresh, f"{i}.json", text.encode())
    assert S.read_json_doc(spark, tmpdir_fresh, split_bytes=3).count() == 0


@pytest.mark.parametrize("piece", [1, 2, 5, 1000])
def test_scanner_in_pieces(piece):
    rng = random.Random(piece)
    text = json.dumps([value(rng) for _ in range(80)]).encode()
    whole = json_ranges.Scanner()
    at, kind, depth, quotes = whole.feed(text)
    parts, scan = [], json_ranges.Scanner()
    for a in range(0, len(text), piece):
        p, k, d, q = scan.feed(text[a:a + piece])
        parts += list(zip((p + a).tolist(), k.tolist(), d.tolist()))
        quotes -= q
    assert parts == list(zip(at.tolist(), kind.tolist(), depth.tolist())) and quotes == 0 and scan.depth == 0


# ------------------------------------------------------------ XML

def random_xml(rng):
    """Random content below a root, with things that look like tags where they are none; and its children."""
    import xml.etree.ElementTree as ET

    def content(depth):
        out = []
        for _ in range(rng.randrange(6) if depth else 30):
            tag = rng.choice(["row", "row", "é", "a.b", "ns-x"])
            inner = content(depth + 1) if depth < 3 else "t &lt; u"
            attributes = rng.choice(["", ' k="a>b"', " x='1' y=\"it's\"", ' z = "/"'])
            out.append(rng.choice([f"<{tag}{attributes}>{inner}</{tag}>", f"<{tag}{attributes}>{inner}</{tag}>", f"<{tag}{attributes}/>",
                                   "<!-- <row> < -- > <row/> -->".replace("-- >", "- >"), "<![CDATA[ <row> </row> ]] > <!-- ]]>", "text\n"]))
        return "".join(out)
    text = f'<?xml version="1.0"?>\n<root a="1">{content(0)}</root>'
    counts: dict = {}
    for c in ET.fromstring(text.encode()):
        counts.setdefault(c.tag, [0, list(c.attrib)])[0] += 1
    return text, counts


def test_xml_children_across_ranges(spark, tmpdir_fresh, monkeypatch):
    from kiln.sources import xml_ranges
    rng, want = random.Random(9), {}
    for n in range(12):
        text, want[f"{n}.xml"] = random_xml(rng)
        put(tmpdir_fresh, f"{n}.xml", text.encode())
        uri = f"file://{tmpdir_fresh}/{n}.xml"
        monkeypatch.setattr(ranges, "PIECE", 13)
        stops = [*range(29, len(text.encode()), 29), ranges._END]
        assert b"".join(d for a, b in zip([0, *stops], stops) for _, d in xml_ranges.tag_pieces(uri, a, b)) == text.encode()
        monkeypatch.undo()
    for split in (37, 1 << 20):
        got: dict = {}
        for r in xml_ranges.child_tags(spark, tmpdir_fresh, split).collect():
            got.setdefault(os.path.basename(r.file), {})[r.tag] = [r.n, r.attributes]
        assert got == {k: v for k, v in want.items() if v}
    for r in S.xml_summary(spark, tmpdir_fresh).collect():
        counts = want[os.path.basename(r.file)]
        best = max(counts, key=lambda t: counts[t][0])
        assert (r.row_tag, r.rows, r.attributes) == (best, *counts[best])
