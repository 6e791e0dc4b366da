"""Cases of the fourth round's finding."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumatrace.operators import dwell, dyes

KEYED = "dataset string, trace_id long"


def test_f1_dwells_are_carried_along_their_traces_and_not_spread_out(spark):
    rng, frames, dwells, want = np.random.default_rng(4), [], [], {}
    for t in range(30):
        n, at = int(rng.integers(1, 60)), 1 + int(rng.integers(0, 4))
        while at <= n:  # dwells with gaps between them; the last may end beyond the trace
            length, state = int(rng.integers(1, 9)), int(rng.integers(1, 4))
            dwells.append(("d", t, state, at, length))
            want |= {(t, f): state for f in range(at, at + length)}
            at += length + int(rng.integers(0, 3))
        frames += [("c", "d", t, f, float(rng.integers(0, 100))) for f in range(1, n + 1) if f % 7]  # a start may be missing
    frames += [("c", "d", 99, 1, 5.0), ("c", "d", None, 2, 6.0)]
    points = spark.createDataFrame(frames, f"condition string, {KEYED}, frame int, total double")
    runs = spark.createDataFrame([*dwells, ("d", None, 2, 1, 9), ("d", 99, 2, 2, None), ("e", 1, 2, 1, 9)], f"{KEYED}, state int, start_frame int, n_frames int")
    got = dwell.to_states(runs, points)
    each, light = dyes.shining(points, runs, 40.0)
    for df in (got, each, light):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan
    assert got.columns == ["dataset", "trace_id", "frame", "state"] and got.schema["frame"].dataType.simpleString() == "int"
    assert {(r.trace_id, r.frame): r.state for r in got.collect()} == {(t, f): want.get((t, f), 0) for _, _, t, f, _ in frames}
    lit = {(t, f): x if want.get((t, f)) == 2 else 0.0 for _, _, t, f, x in frames}
    found = {r.trace_id: (r.total_on, r.photons) for r in each.collect()}
    assert set(found) == {t for t, _ in lit}
    for t, (on, photons) in found.items():
        assert photons == pytest.approx(sum(x for (k, _), x in lit.items() if k == t))
        assert on == pytest.approx(0.04 * sum(want.get((t, f)) == 2 for k, f in lit if k == t))
    assert {r.frame: r.photons for r in light.collect()} == {f: pytest.approx(np.mean([x for (_, k), x in lit.items() if k == f])) for _, f in lit}


def test_f1_a_dye_report_reads_its_points_once_and_ends_in_a_small_plan(spark):
    from lumatrace.plans import pipelines

    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f

    # Traces that shine until frame 150 and blink for three frames in 30 to 50, two files of one condition; the place is the field's middle but for one trace.
    t, f = F.col("trace_id"), F.col("frame")
    alive = (f <= 150) & (f % (30 + t) >= 3)
    noise = 8 * (F.xxhash64("dataset", "trace_id", "frame") % 1000) / 1000
    rows = spark.range(40).select(F.concat(F.lit("f"), F.col("id") % 2).alias("dataset"), F.floor(F.col("id") / 2).alias("trace_id")).withColumn("frame", F.explode(F.sequence(F.lit(1), F.lit(200))))
    rows = rows.withColumns({"time_ms": 40.0 * (f - 1), "donor": F.when(alive, 400.0 + t).otherwise(0.0) + noise, "acceptor": F.lit(0.0), "fret": F.lit(0.0)})
    points = rows.mapInPandas(count, rows.schema)
    places = spark.range(42).select(F.concat(F.lit("f"), F.col("id") % 2).alias("dataset"), F.floor(F.col("id") / 2).alias("trace_id")).withColumns({c: F.when(t == 20, 100.0).otherwise(50.0) for c in ("donor_x", "donor_y")})
    conditions = spark.createDataFrame([("f0", "dye"), ("f1", "dye")], "dataset string, condition string")
    got = pipelines.dye_report(points, places, conditions, 40.0, least_snr=1.0)
    report = {r.name: r for r in got["report"].collect()}
    assert set(report) == {"intensity", "snr", "total_on", "photons"} and {r.files for r in report.values()} == {2}
    assert report["intensity"].value == pytest.approx(410, rel=0.05)
    assert report["photons"].value == pytest.approx(410 * report["total_on"].value / 0.04, rel=0.05)
    assert made.value == 40 * 200
    assert got["report"]._jdf.queryExecution().optimizedPlan().toString().count("\n") < 300
