"""WARC archives: round trips, revisits, dictionaries, offsets, and readers that know nothing but the file."""

import glob
import hashlib
import random
import struct

import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from kiln.llm import warc

BIG = "<html><body>" + "a page that several addresses return. " * 40 + "</body></html>"


def pages_of(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for clash in ("id", "payload", "sha1", "size", "last", "first", "key", "c_size", "a.b"):
        df = df.withColumn(clash, F.lit(clash))
    return df


def brute(rows):
    last, out = {}, []
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(last.get(html or "", i), i)
    copies = {}
    for _, _, html in rows:
        copies[html or ""] = copies.get(html or "", 0) + 1
    for i, _, html in rows:
        b = (html or "").encode()
        top = last.get(html or "")
        again = len(b) >= 1000 and copies[html or ""] > 1 and i != top
        out.append((str(i) if i is not None else None, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response",
                    str(top) if again else None))
    return sorted(out, key=str)


def stored(spark, rows, folder, **args):
    manifest = warc.write_archives(pages_of(spark, rows), folder, **args)
    return manifest, warc.read_archives(manifest)


ROWS = [(i, f"https://example.org/{i}", f"<p>page {i} " + "word " * (i % 300) + "é中\r\n\r\n</p>") for i in range(400)]
ROWS += [(1000 + i, f"https://example.org/copy/{i}", BIG) for i in range(150)]
ROWS += [(2000, None, None), (2001, "", ""), (2002, "a\r\nWARC-Type: x\x00 y", "short"), (2003, "https://é.example/", "short"),
         (None, "u", BIG), (1149, "again", BIG), (5, "again", ROWS[5][2]), (3000, "long", "x" * 3_000_000 + "y"),
         (3001, "edge", "e" * 1000), (3002, "edge", "e" * 1000), (3003, "edge", "f" * 999), (3004, "edge", "f" * 999)]


def test_round_trip(spark, tmpdir_fresh):
    manifest, records = stored(spark, ROWS, tmpdir_fresh + "/w")
    got = records.collect()
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS)
    full = warc.full_payloads(records).collect()
    assert sorted((str(r.id), bytes(r.payload)) for r in full) == sorted((str(i), (h or "").encode()) for i, _, h in ROWS)
    urls = {r.id: r.url for r in got if r.id in ("2000", "2001", "2002", "2003")}
    assert urls == {"2000": None, "2001": "", "2002": "a%0D%0AWARC-Type:%20x%00%20y", "2003": "https://é.example/"}
    assert manifest.count() == len(ROWS)


def test_archives_stand_alone(spark, tmpdir_fresh):
    manifest, records = stored(spark, ROWS, tmpdir_fresh + "/w", archive_bytes=4_000)
    files = glob.glob(tmpdir_fresh + "/w/archives/*.warc.zst")
    assert len(files) > 5 and {r.file for r in manifest.select("file").distinct().collect()} == {f"file://{f}" for f in files}
    indexed = {(r.file, r.offset): r.id for r in manifest.collect()}
    found = {}
    for f in files:
        raw = open(f, "rb").read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D and raw[8 + size:12 + size] == b"\x28\xb5\x2f\xfd"
        kinds = []
        for at, record in warc.scan_archive(f"file://{f}", chunk=777):
            got = warc.parse_record(record)
            kinds.append(got and got[0])
            if got:
                found[f"file://{f}", at] = got[1]
        assert kinds[0] is None and all(kinds[1:])
    assert found == indexed
    assert sorted(((r.id, r.payload_bytes) for r in records.collect()), key=str) == sorted(((r[0], r[1]) for r in brute(ROWS)), key=str)


def test_dictionary_pays(tmpdir_fresh):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(300)]
    out = warc.ArchiveWriter(f"file://{tmpdir_fresh}", 1 << 30, 3)
    plain = 0
    for i in range(2_000):
        html = f"<html><head><title>{i}</title></head><nav>home about contact</nav>" + " ".join(rng.choices(words, k=60))
        raw = warc.make_record(str(i), f"https://example.org/{i}", html.encode(), hashlib.sha1(html.encode()).hexdigest(),
                               len(html.encode()), None, False)
        plain += len(zstd.ZstdCompressor(level=3).compress(raw))
        out.add(str(i), "response", raw)
    out.end()
    assert sum(r[2] for r in out.index) < 0.6 * plain


@pytest.mark.parametrize("rows", [[], [(1, "u", None)], [(1, "u", "same")] * 3])
def test_small_tables(spark, tmpdir_fresh, rows):
    manifest, records = stored(spark, rows, tmpdir_fresh + "/w")
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()), key=str) == brute(rows)


def test_damage_is_seen():
    raw = warc.make_record("1", "u", b"payload", hashlib.sha1(b"payload").hexdigest(), 7, None, False)
    assert warc.parse_record(raw)[1] == "1"
    for bad in (raw[:-1], raw.replace(b"payload\r\n", b"pbyload\r\n"), b"x" + raw):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_ids_read_back():
    for key in ("7", "-3", "", "a b/é:<>", None):
        assert warc.key_of(warc.record_id(key)) == key
