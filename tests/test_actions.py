"""The batch action gate against the state machine, one run over many parts."""

import datetime as dt
import random

import pytest

from kiln.operators import telemetry as H


def polls(seed, n, step, runs):
    rng = random.Random(seed)
    names = [None, None, "disk_low", "hang_detected", "hang_detected", "process_dead", "oom_risk_gpu0"]
    rows = []
    for r in range(runs):
        t = 1_700_000_000_000_000 + rng.randrange(10 ** 9)
        for _ in range(n if r == 0 else n // 20):
            t += rng.choice([step, step, 2 * step, 300_000_000 - step, 300_000_000])
            rows.append((f"run{r}", dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=t),
                         rng.choice(names if rng.random() < 0.9 else names[2:])))
    return rows


@pytest.mark.parametrize("seed,step", [(1, 5_000_000), (2, 60_000_000), (3, 299_999_999), (4, 1)])
def test_equals_the_state_machine(spark, seed, step):
    rows = polls(seed, 2_000, step, 4)
    df = spark.createDataFrame(rows, "run_id string, ts timestamp, anomaly string")
    got = sorted(((r.run_id, r.ts, r.anomaly, r["count"]) for r in H.actions(df.repartition(7)).collect()), key=str)
    want = []
    frame = df.toPandas()
    for run_id, g in frame.groupby("run_id", dropna=False):
        g = g.sort_values("ts")
        g = g.assign(in_grace=(g["ts"] - g["ts"].min()).dt.total_seconds() < 30)
        out, _ = H.gate_actions(g)
        want += [(r.run_id, r.ts.to_pydatetime(), r.anomaly, r.count) for r in out.itertuples(index=False)]
    assert got == sorted(want, key=str) and len(got) > 20


def test_nothing_to_do(spark):
    schema = "run_id string, ts timestamp, anomaly string"
    assert H.actions(spark.createDataFrame([], schema)).count() == 0
    now = dt.datetime(2024, 1, 1)
    assert H.actions(spark.createDataFrame([("a", now, None), ("b", now, "disk_low")], schema)).count() == 0
