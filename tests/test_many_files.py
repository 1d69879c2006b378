"""Many small files: written and listed by tasks, never one by one on the driver."""
import os
import re

from pyspark.sql import functions as F

from kiln.sources import files as S
from kiln.sources import ranges, sinks, xml_ranges


def put(folder, name, text):
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "w", newline="") as f:
        f.write(text)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_folders_are_listed_by_tasks_as_spark_lists_them(spark, tmpdir_fresh):
    for name in ("k=a b/j=1/f é.txt", "k=x%3Ay/j=1/g.txt", "k=x%3Ay/j=2/h+i.txt", "k=x%3Ay/j=2/.hidden",
                 "k=x%3Ay/j=2/_SUCCESS", "k=c/j=3/" + "#1.txt", "_no/f.txt", ".no/f.txt"):
        put(tmpdir_fresh, name, name)
    put(tmpdir_fresh, "k=c/j=3/empty.txt", "")
    for path in (tmpdir_fresh, f"file:{tmpdir_fresh}/", f"file://{tmpdir_fresh}", f"{tmpdir_fresh}/k=c"):
        for recursive in (False, True):
            b = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
            want = b.select(F.col("_metadata.file_path").alias("file"), "path", "length", "modificationTime")
            got = ranges.walk(spark, path, recursive)
            assert "binaryFile" not in plan(got) and "Scan" not in plan(got)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    put(tmpdir_fresh, "sub/deep/er/still/s.txt", "s")
    assert ranges.walk(spark, tmpdir_fresh).count() == 4 and ranges.walk(spark, tmpdir_fresh, True).count() == 5
    assert ranges.list_files(spark, f"{tmpdir_fresh}/k=c/j=3/*.txt").count() == 1


def test_long_listings_go_on_in_parts(spark, tmpdir_fresh, monkeypatch):
    run = ranges._listed(True, True)
    for i in range(30):
        put(tmpdir_fresh, f"a/b{i}/c/{i}.txt", "x")
    import pyarrow as pa
    seed = ranges._rows(ranges._LISTED, [(f"file:{tmpdir_fresh}/a", None, None, None), ("file:/x", "/x", 5, 0)])
    got = pa.Table.from_batches(list(run([seed, seed])))
    assert sorted(got["length"].to_pylist()) == [1] * 60 + [5] * 2


def test_files_are_written_by_tasks_as_partition_by_writes_them(spark, tmpdir_fresh):
    rows = [("a b", 1, "x"), ("a b", 1, None), ("a b", 1, "y\r"), ("a/b:c%", 2, "z"), (None, 3, ""), ("", 3, "w"), ("é", None, "v")]
    df = spark.createDataFrame(rows, "k string, j bigint, t string").coalesce(1)
    assert sinks.write_files(df, f"{tmpdir_fresh}/ours", ["k", "j"], "t") == 7
    assert sinks.write_files(df, f"{tmpdir_fresh}/ours", ["k", "j"], "t") == 7  # a task that runs again
    df.write.partitionBy("k", "j").text(f"{tmpdir_fresh}/spark")

    def read(at):
        d = spark.read.text(f"{tmpdir_fresh}/{at}").select("k", "j", "value")
        folders = {os.path.relpath(r, f"{tmpdir_fresh}/{at}") for r, _, f in os.walk(f"{tmpdir_fresh}/{at}") if r.count("=") > 1}
        return sorted(map(str, d.collect())), folders
    assert read("ours") == read("spark")
    assert not [f for _, _, found in os.walk(f"{tmpdir_fresh}/ours") for f in found if f.startswith(".")]


XML = ('<?xml version="1.0"?><root><!-- <row id="0"/> --><meta/><row id="1"><v>a &lt; b</v></row><![CDATA[<row>]]>'
       '<row id="2"/><x><row id="3"><row id="4"><v>in</v></row><v a=">">c<!--</row>--></v></row></x><rows/>'
       '<row id="5"><v>' + "long " * 40 + '</v></row></root>')


def test_xml_records_across_ranges(spark, tmpdir_fresh):
    put(tmpdir_fresh, "a/a.xml", XML)
    put(tmpdir_fresh, "a/b.xml", "<root>" + "".join(f'<row id="{i}"><v>{i}</v></row>' for i in range(50)) + "</root>")
    want = sorted([m[0] for m in re.finditer(r'<row id="[12]".*?(?:</row>|/>)|<row id="3".*?</row>(?=</x>)|<row id="5".*?</row>',
                                             XML.replace('<!-- <row id="0"/> -->', ""))]
                  + [f'<row id="{i}"><v>{i}</v></row>' for i in range(50)])
    for split in (7, 31, 64, 1 << 20):
        assert sorted(r.record for r in xml_ranges.records(spark, f"{tmpdir_fresh}/a", "row", split).collect()) == want


def test_xml_schema_is_inferred_by_many_tasks(spark, tmpdir_fresh):
    for i in range(40):
        put(tmpdir_fresh, f"k={i}/d.xml", f'<root><m/><row id="{i}"><v>{i}.5</v></row><row id="{i}"><w>t</w></row></root>')
    got = S.read_xml(spark, tmpdir_fresh)
    assert sorted(got.dtypes) == [("_id", "bigint"), ("v", "double"), ("w", "string")]
    assert got.agg(F.sum("v"), F.count("w")).first()[:] == (sum(range(40)) + 20.0, 40)
    assert "Scan xml" not in plan(got)
    typed = S.read_xml(spark, tmpdir_fresh, schema="_id string, v string")
    assert typed.dtypes == [("_id", "string"), ("v", "string")] and typed.count() == 80


def test_documents_are_read_by_tasks(spark, tmpdir_fresh):
    for i in range(20):
        put(tmpdir_fresh, f"k={i}/d.json", f'{{"version": 1, "rows": [{{"id": {i}}}, {{"id": {i + 100}}}]}}')
    got = S.read_json_doc(spark, tmpdir_fresh)
    assert "Scan text" not in plan(got)
    assert got.agg(F.sum(F.variant_get("rec", "$.id", "bigint"))).first()[0] == 2 * sum(range(20)) + 2000


def test_tree_and_logs_are_written_by_as_many_tasks_as_shuffles_have(spark, tmpdir_fresh, monkeypatch):
    from kiln.plans import sources
    rows = [(i, f"s{i % 3}", "x" if i % 2 else None) for i in range(0, 900, 7)]
    spark.createDataFrame(rows, "doc_id bigint, source string, lang string").write.parquet(f"{tmpdir_fresh}/documents.parquet")
    grouped = []
    monkeypatch.setattr(sources, "_grouped", lambda df, *by, f=sources._grouped: grouped.append(f(df, *by)) or grouped[-1])
    tree = sources._tree(spark, tmpdir_fresh)
    assert [g.rdd.getNumPartitions() for g in grouped] == [8, 8]
    inv = S.file_inventory(spark, tree).collect()
    assert len([r for r in inv if r.ext == ".png"]) == len(rows)
    assert sorted({r.rel.rsplit("/", 1)[0] for r in inv if r.is_data}) == sorted(
        {f"data/source={s}/chunk={i // 200}" for i, s, _ in rows})
    got = spark.read.schema("doc_id bigint, lang string, source string").json(f"{tree}/data").select("doc_id", "source", "lang")
    assert sorted(map(tuple, got.collect())) == rows


class Handle:
    """A key's state store that counts its calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def _call(self):
        self.calls += 1

    def exists(self):
        self._call()
        return self.value is not None

    def get(self):
        self._call()
        return self.value

    def update(self, value):
        self._call()
        self.value = value

    def listTimers(self):
        self._call()
        return list(self.timers)

    def deleteTimer(self, at):
        self._call()
        self.timers.discard(at)

    def registerTimer(self, at):
        self._call()
        self.timers.add(at)


def test_live_logs_cost_few_calls_of_the_state_store():
    import pandas as pd

    from kiln.streaming.live import _Hang, _Latest
    at = lambda *s: pd.DataFrame({"ts": pd.to_datetime(list(s), unit="s")})
    store, hang = Handle(), _Hang(300.0, True)
    hang.init(store)
    assert list(hang.handleInputRows(("r",), [at(10, 0), at(20)], None)) == [] and store.calls == 3
    assert store.timers == {320_001}
    found = list(hang.handleInputRows(("r",), [at(400)], None))
    assert [f.silent_s.tolist() for f in found] == [[380.0]] and store.calls == 7 and store.timers == {700_001}
    store, latest = Handle(), _Latest(None)
    latest.init(store)
    rows = pd.DataFrame({"step": [1, 3, 2], "loss": [1.0, None, 2.0], "eval_loss": [None] * 3, "lr": [None] * 3, "throughput": [None] * 3,
                         "ingest_ts": pd.to_datetime([0, 0, 0], unit="s"), "block": [0, 0, 0], "pos": [1, 3, 2]})
    got = next(latest.handleInputRows(("r",), iter([rows]), None))
    assert store.calls == 2 and got.step.tolist() == [3] and got.loss.isna().all() and str(got.step.dtype) == "Int64"
    list(latest.handleInputRows(("r",), iter([rows.assign(pos=0)]), None))
    assert store.value[0] == 3


def test_skeleton_reads_the_logs_no_more_than_twice(spark, tmpdir_fresh):
    from kiln.operators import logs
    rows = [("a", i, f"loss {i}" if i % 9 == 0 else f"line {i % 50}") for i in range(1, 900)] + [("b", i, "x") for i in range(1, 9)]
    spark.createDataFrame(rows, "log_id string, line_no bigint, line string").write.parquet(f"{tmpdir_fresh}/l")
    got = logs.skeleton(spark.read.parquet(f"{tmpdir_fresh}/l"), 20)
    assert f"{tmpdir_fresh}/l" not in got._jdf.queryExecution().optimizedPlan().toString() + str(got.inputFiles())
    lines = {(r.log_id, r.seq): r.line for r in got.collect()}
    assert [lines["b", float(i)] for i in range(1, 9)] == ["x"] * 8
    last = max(s for log, s in lines if log == "a")
    assert [lines["a", s] for s in (1.0, 6.0, 11.0, last)] == ["line 1", "loss 9", "...[truncated]...", "line 49"]
