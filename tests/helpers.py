"""Inline request rows for operator tests."""

import datetime as dt

from pyspark.sql import functions as F

from rampstat.schema import REQUEST

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def request_df(spark, rows):
    """rows: dicts with any REQUEST fields; the rest default."""
    base = {"run_id": 0, "seq": None, "ts": T0, "stage_index": 0, "model": "m",
            "model_percentage": 100.0, "token_index": 0, "token_label": "user-a", "active_users": 1,
            "target_rps": 5.0, "status": "success", "status_code": 200, "latency_ms": 100.0,
            "error_type": None, "suite_id": "coding", "prompt_id": "0"}
    out = []
    for i, r in enumerate(rows):
        d = dict(base)
        d.update(r)
        if d["seq"] is None:
            d["seq"] = i + 1
        if "ts" not in r:
            d["ts"] = T0 + dt.timedelta(seconds=i)
        out.append(tuple(d[f.name] for f in REQUEST.fields))
    df = spark.createDataFrame(out, REQUEST)
    return df.withColumn("event_id", F.col("seq"))


def schedule_df(spark, stages, run_id=0):
    """stages: list of (stage_index, target_rps, active_users, duration)."""
    rows = []
    t = 0.0
    for s, rps, users, dur in stages:
        rows.append((run_id, s, rps, users, dur, t, t + dur))
        t += dur
    return spark.createDataFrame(
        rows, "run_id bigint, stage_index int, target_rps double, active_users int, duration double, "
              "t0_offset_s double, t1_offset_s double")
