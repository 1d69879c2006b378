"""JVM-side helpers shipped as a small jar (``kiln/jvm``): registered per
session as SQL functions so the work runs in the executors' JVM without a
Python round trip. Callers fall back to the Python kernels when the jar
cannot be loaded."""

from __future__ import annotations

import logging
import os

from pyspark.sql import SparkSession

JAR = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "jvm", "kiln-udfs.jar")
FUNCTIONS = {"kiln_levenshtein": "kiln.udf.BitLevenshtein", "kiln_word_levenshtein": "kiln.udf.WordLevenshtein",
             "kiln_token_levenshtein": "kiln.udf.TokenLevenshtein"}
_READY: dict[str, bool] = {}


def register(spark: SparkSession) -> bool:
    """Add the jar to the session and register its functions (once per
    application). Returns whether they are available."""
    try:
        key = spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - no JVM handle (Spark Connect): Python kernels
        return False
    if key in _READY:
        return _READY[key]
    ok = False
    if os.path.exists(JAR):
        try:
            spark.sql(f"ADD JAR '{JAR}'")
            jss = spark._jsparkSession
            loader = jss.sharedState().jarClassLoader()
            long_type = spark._jvm.org.apache.spark.sql.types.DataTypes.LongType
            for name, cls in FUNCTIONS.items():
                inst = loader.loadClass(cls).newInstance()
                jss.udf().register(name, inst, long_type)
            ok = True
        except Exception as e:  # noqa: BLE001 - any failure means: use the Python kernels
            logging.getLogger(__name__).warning("JVM functions unavailable, the Python kernels run instead: %s", e)
            ok = False
    _READY[key] = ok
    return ok


def available() -> bool:
    """Whether the JVM functions are registered in the active session."""
    spark = SparkSession.getActiveSession()
    return bool(spark) and register(spark)
