"""Checks of recordings, and small functions that no query runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumatrace.operators import combine, pixels, project
from lumatrace.sources import files
from lumatrace.streaming import ingest
from tests.test_library import _bright

POINTS = "dataset string, trace_id long, frame int, time_ms double, donor double, acceptor double"


def points_of(spark, lengths, dataset="d"):
    return spark.createDataFrame([(dataset, t, f, 40.0 * f, 1.0, 2.0) for t, n in lengths.items() for f in range(1, n + 1)], POINTS)


def test_broken_recordings_are_named(spark):
    points = points_of(spark, {1: 3, 2: 3})
    traces = spark.createDataFrame([("d", 1), ("d", 2)], "dataset string, trace_id long")
    assert not any(project.check_recordings(points, traces).values()) and project.require_valid(points, traces) is points
    bad = project.check_recordings(points.unionByName(points_of(spark, {3: 2})).withColumn("glow", F.lit(1)).drop("donor"), traces.union(traces.filter("trace_id = 1")).union(spark.createDataFrame([("d", 9)], traces.schema)))
    assert {k: n for k, n in bad.items() if n} == {"unequal_lengths": 1, "unknown_channels": 1, "no_light": 1, "without_metadata": 1, "without_points": 1, "repeated_metadata": 1}
    with pytest.raises(ValueError, match="without_metadata"):
        project.require_valid(points, traces.limit(1))


def test_defaults_of_metadata(spark):
    got = project.with_defaults(spark.createDataFrame([("d", 1, None, 0.2), ("d", 2, "off", None)], "dataset string, trace_id long, zero_method string, crosstalk double")).orderBy("trace_id").collect()
    assert [tuple(r[2:]) for r in got] == [("threshold", 0.2, 1.0), ("off", 0.0, 1.0)]


def test_spans_of_frames(spark):
    got = {r.trace_id: (r.first, r.last) for r in project.frame_span(points_of(spark, {1: 9, 2: 2}), F.col("frame").between(4, 6)).select("trace_id", F.col("first"), F.col("last")).toDF("trace_id", "first", "last").collect()}
    assert {k: tuple(v) for k, v in got.items()} == {1: (4, 6), 2: (None, None)}


def test_appending_needs_equal_recordings(spark):
    a, b = points_of(spark, {1: 3}), points_of(spark, {2: 3})
    meta = lambda t, **more: spark.createDataFrame([{"dataset": "d", "trace_id": t, **more}])
    points, traces = combine.append_recordings((a, meta(1, ids="x")), (b, meta(2, ids="y")))
    assert points.count() == 6 and {r.ids for r in traces.collect()} == {"x", "y"}
    assert combine.append_recordings((a, meta(1, ids="x")), (b, meta(2, other=1)))[1].columns == ["dataset", "trace_id"]
    with pytest.raises(ValueError, match="lengths"):
        combine.append_recordings((a, meta(1)), (points_of(spark, {2: 4}), meta(2)))
    with pytest.raises(ValueError, match="channels"):
        combine.append_recordings((a, meta(1)), (b.drop("acceptor"), meta(2)))


def test_misalignment(spark):
    at = "movie string, mol_id long, cx double, cy double"
    a, b = spark.createDataFrame([("m", 1, 0.0, 0.0), ("m", 2, 5.0, 5.0), ("m", 3, 9.0, 9.0)], at), spark.createDataFrame([("m", 1, 3.0, 4.0), ("m", 2, 5.0, 5.0)], at)
    assert pixels.misalignment(a, b).first().rms == pytest.approx(12.5**0.5)


def test_points_without_neighbours(spark):
    p = spark.createDataFrame([("d", 1, 0.0, 0.0), ("d", 2, 3.0, 0.0), ("d", 3, 9.0, 9.0), ("e", 1, 3.0, 0.1)], "dataset string, id long, x double, y double")
    assert {(r.dataset, r.id) for r in combine.without_neighbours(p, 3.5, ["dataset"]).collect()} == {("d", 3), ("e", 1)}


def test_differing_sampling(spark):
    a, b = spark.createDataFrame([("d", 40.0), ("e", 40.0)], "dataset string, sampling_ms double"), spark.createDataFrame([("d", 40.0), ("e", 100.0)], "dataset string, sampling_ms double")
    assert [r.dataset for r in combine.same_sampling(a, b).collect()] == ["e"]


def test_listing_and_latest_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.TRACES", "b.traces", "sub/c.rawtraces", "d.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = files.list_files(spark, str(tmp_path), r"\.(raw)?traces$")
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.TRACES", "b.traces", "c.rawtraces"]
    old = spark.createDataFrame([("x", 5), ("y", 7), ("z", 7)], "path string, modificationTime int")
    assert [r.path for r in ingest.latest(old, 2).collect()] == ["y", "z"]


def test_fret_with_the_donor_found_alive_by_states(spark):
    got = project.fret_two(_bright(spark, 3).drop("fret"), zero="skm").toPandas()
    assert (got[got.frame > 121].fret == 0).all()
    lit = got[(got.frame > 2) & (got.frame < 118)]
    assert (lit.fret > 0.1).mean() > 0.97
