"""Session construction and the few settings the operators rely on."""

from __future__ import annotations

import logging
import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every operator assumes. They are session-scoped SQL confs, so
# ``ensure_conf`` can apply them to a session someone else built.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # JSON with repeated keys parses, last value wins (as Python's json does).
    "spark.sql.variant.allowDuplicateKeys": "true",
    # eval_<key> maps: a repeated key keeps its last value.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def ensure_conf(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings, ship the package to Python workers and register
    the JVM functions on a session someone else built (idempotent)."""
    for k, v in SQL_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    try:
        ship_package(spark)
    except RuntimeError:
        raise
    except Exception as e:  # noqa: BLE001 - e.g. a Spark Connect session: ship as an artifact instead
        logging.getLogger(__name__).warning("package not shipped through the checkpoint folder: %s", e)
        _ship_artifact(spark)
    from kiln.functions import jvm
    jvm.register(spark)
    return spark


def _ship_artifact(spark: SparkSession) -> None:
    """Spark Connect sessions have no SparkContext: add the package as a
    Python artifact of the session (client-side zip)."""
    import io
    import zipfile
    try:
        pkg = os.path.dirname(os.path.abspath(__file__))
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for root, _dirs, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
        d = tempfile.mkdtemp(prefix="kiln-artifact-")  # client-side staging only
        path = os.path.join(d, "kiln.zip")
        with open(path, "wb") as fh:
            fh.write(buf.getvalue())
        spark.addArtifacts(path, pyfile=True)
    except Exception as e:  # noqa: BLE001 - workers may already import kiln
        logging.getLogger(__name__).warning("package not added as an artifact: %s", e)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``kiln`` importable in the Python workers (its Arrow UDFs and
    pandas functions are pickled by reference): zip the package once per
    SparkContext into the checkpoint folder and ``addPyFile`` it, as
    ``--py-files`` would on a cluster."""
    import io
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    from pyarrow import fs
    base = checkpoint_dir(spark).rstrip("/")
    uri = base if "://" in base else "file://" + base.replace("file:", "", 1)
    filesystem, root = fs.FileSystem.from_uri(uri)
    filesystem.create_dir(f"{root}/kiln-code", recursive=True)
    target = f"{root}/kiln-code/kiln-{key}.zip"
    with filesystem.open_output_stream(target) as out:
        out.write(buf.getvalue())
    sc.addPyFile(target if "://" not in base else f"{base}/kiln-code/kiln-{key}.zip")
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only a local master may go without: it gets a fresh scratch folder. On a
    cluster ``spark.checkpoint.dir`` must name shared storage.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="kiln-ckpt-", dir=os.environ.get("KILN_SCRATCH", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "kiln") -> SparkSession:
    """Build (or get) a session with the settings above, UI off, and a
    checkpoint folder (the cluster's, or a scratch one when none is set)."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    # local mode runs every task in the driver JVM; cluster mode ignores this
    b = b.config("spark.driver.memory", os.environ.get("KILN_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in SQL_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ensure_conf(spark)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files under the shared checkpoint
    folder (never a machine-local temp folder on a cluster)."""
    import uuid
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/kiln-scratch/{name}-{uuid.uuid4().hex[:12]}"
