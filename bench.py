"""Headline-operator benchmark.

/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}``,
with ``sec_per_gb``: seconds per GB of the table that each query reads, so that
runs at two scales show the growth.
Each query is forced with a ``noop`` write (full evaluation, no collect);
the time is the median of warm runs (one warm-up run first).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = {
    "C05": "C05_clean_stats_by_source",
    "P09": "P09_profile_by_source",
    "M01": "M01_split_exact",
    "M11": "M11_mix_by_ratio",
    "T07": "T07_ocr_metrics",
    "L01": "L01_parse_metrics",
    "L06": "L06_final_metrics",
    "E14": "E14_factor_trend",
    "R11": "R11_checkpoints_to_drop",
    "H06": "H06_classify_health",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from kiln.plans.catalog import queries
    from kiln.session import get_session

    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app_name="kiln-bench")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 * 1024 * 1024))
    qs = queries()
    size = {t: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(sf_dir) for f in fs
                   if f == f"{t}.parquet" or os.path.basename(d) == f"{t}.parquet") / 1e9 for t in ("documents", "events")}
    out: dict[str, float] = {}
    rows: dict[str, int] = {}
    for short, name in HEADLINE.items():
        def run() -> float:
            t = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t
        first = run()
        n = runs if first < 30 else 1
        times = [run() for _ in range(n)]
        out[short] = round(statistics.median(times), 3)
        rows[short] = qs[name](spark, sf_dir).count()
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "rows": rows, "sec_per_gb": {
                          k: round(v / size["documents" if k[0] in "CPMT" else "events"], 1) for k, v in out.items()},
                       "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
