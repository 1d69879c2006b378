"""Sinks and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.operators.clean import nan_to_null
from kiln.session import scratch_path
from kiln.sources import ranges


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; NaN written as null, nulls kept as explicit keys."""
    nan_to_null(df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split", fmt: str = "json") -> None:
    """One folder per split value (``partitionBy``)."""
    w = nan_to_null(df).write.mode("overwrite").partitionBy(split)
    (w.option("ignoreNullFields", "false").json(path) if fmt == "json" else w.format(fmt).save(path))


# Characters that a folder's name has escaped, as Spark's ``partitionBy`` does.
_ESCAPED = {c: f"%{ord(c):02X}" for c in [*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"]}


def write_files(df: DataFrame, path: str, by: list[str], value: str, suffix: str = ".txt") -> int:
    """Text files ``path``/by=.../, one for each run of rows with equal ``by`` (as many as there are groups where
    ``df`` brings a group's rows one after another in one task), a line a row. ``partitionBy`` has the driver move
    each file to its place, one by one; here the task that wrote a file does. A file takes its name from its group, so
    a task that runs again replaces its own files. Returns the number of lines."""
    store_uri = path if "://" in path else "file://" + path.replace("file:", "", 1)
    if not ranges.reachable(df.sparkSession, path):
        df.select(*by, value).write.partitionBy(*by).mode("overwrite").text(path)
        return df.count()
    names = list(by)

    def run(batches):
        import hashlib
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        store, root = fs.FileSystem.from_uri(store_uri)
        made, at, out, place, lines = set(), None, None, None, 0

        def end():
            out.close()
            store.move(*place)
        try:
            for batch in batches:
                *keys, texts = (c.to_pylist() for c in batch.columns)
                lines += len(texts)
                first = 0
                runs = list(zip(*keys))
                for i in range(1, len(runs) + 1):
                    if i < len(runs) and runs[i] == runs[first]:
                        continue
                    if out is None or runs[first] != at:
                        if out is not None:
                            end()
                        at = runs[first]
                        folder = "/".join(f"{k}=" + ("__HIVE_DEFAULT_PARTITION__" if v in (None, "") else "".join(
                            _ESCAPED.get(c, c) for c in str(v))) for k, v in zip(names, at))
                        folder = f"{root.rstrip('/')}/{folder}"
                        if folder not in made:
                            store.create_dir(folder, recursive=True)
                            made.add(folder)
                        name = hashlib.md5(repr(at).encode()).hexdigest()
                        place = (f"{folder}/.{name}-{uuid.uuid4().hex}.tmp", f"{folder}/part-{name}{suffix}")
                        out = store.open_output_stream(place[0], compression=None)
                    out.write(b"".join(x for t in texts[first:i] for x in (t or b"", b"\n")))
                    first = i
            if out is not None:
                end()
                out = None
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([lines], pa.int64())], names=["n"])
    rows = df.select(*by, F.col(value).cast("binary").alias(value))
    return rows.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def append_notifications(df: DataFrame, path: str) -> None:
    """Append-only notification log (timestamp, level, message, work_dir)."""
    cols = [c for c in ("level", "message", "work_dir") if c in df.columns]
    df.select(F.current_timestamp().alias("timestamp"), *cols).write.mode("append").json(path)


def _arrival(new: DataFrame, order: str | None):
    """Column by which rows of ``new`` arrived: the named one, else their place in the input."""
    return F.col(order) if order else F.monotonically_increasing_id()


def resolve(new: DataFrame, key: list[str], order: str | None = None, keep: str = "last") -> DataFrame:
    """One row for each key of ``new``: the last or first by ``order`` (rows of equal order: the greatest or least
    row, so that reruns agree). A partial aggregate: a key that most rows share is folded before the shuffle."""
    whole = F.struct(*[F.col(f"`{c}`") for c in new.columns])
    x = new.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(key)], whole.alias("_row"),
                   F.struct(_arrival(new, order).alias("at"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("row")).alias("_at"))
    pick = {"last": F.max_by, "first": F.min_by}[keep]
    return x.groupBy(*[f"_key{i}" for i in range(len(key))]).agg(pick("_row", "_at").alias("_row")).select("_row.*")


def _without(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not among those of ``others``; null is a key like any other."""
    found = others.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(key)]).distinct()
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(key)]
    return rows.join(found, same, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """The table as it is after every row of ``new``, one after another by ``order``, replaced the row of
    its key or was appended: of a key's new rows the last one counts, other old rows stay."""
    return _without(old, new, key).unionByName(resolve(new, key, order), allowMissingColumns=True)


def upsert_index(old: DataFrame, new: DataFrame, key: str = "source_path", order: str | None = None) -> DataFrame:
    """Dataset index, last writer wins per ``source_path``."""
    return upsert(old, new, [key], order)


def upsert_experiments(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Experiment records, replaced by (id, run_id) else appended."""
    return upsert(old, new, ["id", "run_id"], order)


def append_if_absent(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """New rows whose key is not present yet; existing rows keep their state, and so does the first of a key's
    new rows."""
    return old.unionByName(_without(resolve(new, key, order, "first"), old, key), allowMissingColumns=True)


def merge_into(spark: SparkSession, path: str, new: DataFrame, key: list[str], order: str | None = None,
               how: str = "upsert", buckets: int = 64) -> None:
    """Merge ``new`` into the table at ``path`` (parquet in ``buckets`` folders by the key's hash), rewriting the
    buckets that its keys fall into and no others. ``how``: ``upsert`` (K04, K05) or ``absent`` (K06). The merged
    buckets are written aside first, then take the old ones' places; repeating a merge that was broken off gives the
    table that the merge alone would have given. The number of buckets is the table's: keep it between merges."""
    hashed = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(buckets)).cast("int")
    fresh = scratch_path(spark, "merge-new")
    new.withColumn("bucket", hashed).write.parquet(fresh)
    new = spark.read.parquet(fresh)
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    if store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store):
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched))
        merged = {"upsert": upsert, "absent": append_if_absent}[how](old, new, key, order)
    else:
        merged = resolve(new, key, order, {"upsert": "last", "absent": "first"}[how])
    aside = scratch_path(spark, "merge-aside")
    # few files a bucket; Spark splits a bucket that is large
    merged.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(aside)
    (spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
          .partitionBy("bucket").parquet(path))


# ------------------------------------------------------------ batches of a stream

def write_batch(batch: DataFrame, path: str, query: str, batch_id: int) -> None:
    """One batch of a stream into the folder of its own, ``path``/query=.../batch=.... A batch that is run
    again, because its query ended between the write and its own commit, replaces what it wrote before; half-written
    files of a lost attempt are never among those that Spark's writer commits. So each batch's rows are there once."""
    (batch.withColumn("timestamp", F.current_timestamp())
          .write.mode("overwrite").json(f"{path}/query={query}/batch={batch_id}"))


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that ``write_batch`` wrote, with ``query`` and ``batch``."""
    return spark.read.schema(f"{schema}, timestamp timestamp, query string, batch bigint").json(path)
