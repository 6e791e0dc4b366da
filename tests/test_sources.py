"""Trace files of every version and their metadata, written and read back."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumatrace.operators import correct, project
from lumatrace.sources import files, legacy, metadata


def value_of(v):
    """Plain form of a value, to compare."""
    if v is None:
        return None
    kind, dims, content = v
    if kind == "struct":
        return kind, dims, [{k: value_of(x) for k, x in e.items()} for e in content]
    if kind == "cell":
        return kind, dims, [value_of(x) for x in content]
    return kind, dims, content if kind == "char" else np.asarray(content).tolist()


def number(kind, *values, dims=None):
    return kind, dims or [1, len(values)], np.array(values)


def char(s):
    return "char", [1, len(s)], s


ROOT = ("struct", [1, 1], [{
    "fileMetadata": ("struct", [1, 1], [{
        "wavelengths": number("double", 532.0, 640.0), "chDesc": ("cell", [1, 2], [char("Cy3"), ("cell", [1, 1], [number("uint8", 7)])]), "crosstalk": number("double", 0.0, 0.1, 0.2, 0.3, dims=[2, 2]), "big": number("int64", 2**60 + 1, -5),
        "geometry": ("struct", [1, 2], [{"name": char("left"), "flip": number("logical", 1, dims=[1, 1])}, {"name": char("right"), "flip": number("logical", 0, dims=[1, 1])}]), "empty": ("double", [0, 0], np.array([])), "note": char(""),
    }]),
    "traceMetadata": ("struct", [1, 4], [{"ids": char(f"movie#{i}"), "donor_x": number("single", i + 0.5, dims=[1, 1]), "scale": number("double", i, 2 * i, dims=[1, 2]), "m": number("int16", *range(i, i + 6), dims=[2, 3]), "mixed": char("a") if i % 2 else number("double", 1.0, dims=[1, 1])} for i in range(4)]),
}])


def test_values_come_back():
    data = metadata.encode(ROOT)
    got, end = metadata.decode(data)
    assert end == len(data) and value_of(got) == value_of(ROOT)


def test_packed_pages_are_as_the_format_has_them():
    rows = ("struct", [1, 2], [{"ids": char("a"), "x": number("double", 1.0, dims=[1, 1])}, {"ids": char("bc"), "x": number("double", 2.0, dims=[1, 1])}])
    ids = struct.pack("<BIBII", 0, 9 + 4, 2, 1, 4) + b"a\x1fbc"
    x = struct.pack("<BIBIII", 10, 13 + 16, 3, 1, 1, 2) + struct.pack("<2d", 1, 2)
    body = struct.pack("<BIIB", 2, 1, 2, 2) + b"\x03ids\x01" + ids + b"\x01x\x01" + x
    assert metadata.encode(rows) == struct.pack("<BI", 13, len(body)) + body


def test_unknown_types_are_passed_over_and_faulty_sizes_raise():
    odd = struct.pack("<BI", 99, 3) + b"abc"
    assert metadata.decode(odd) == (None, len(odd))
    with pytest.raises(ValueError, match="size"):
        metadata.decode(struct.pack("<BIBII", 1, 12, 2, 1, 2) + b"\1\2\3")


def test_rows_describe_all_fields():
    rows = list(metadata.rows_of("f", ROOT))
    again = metadata.decode(metadata.page([(r[1], r[2], *r[3:]) for r in rows], 4))[0]
    assert value_of(again) == value_of(ROOT)
    assert {r[3] for r in rows if r[1] == "file"} == {"wavelengths", "chDesc{1}", "chDesc{2}{1}", "crosstalk", "big", "geometry[1].name", "geometry[1].flip", "geometry[2].name", "geometry[2].flip", "empty", "note"}


def points_of(spark, name, n, m, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(name, i + 1, f + 1, 40.0 * f, *map(float, rng.integers(0, 500, 2)), 0.25) for i in range(n) for f in range(m)]
    return spark.createDataFrame(rows, "dataset string, trace_id long, frame int, time_ms double, donor double, acceptor double, fret double")


def test_files_keep_their_metadata(spark, tmp_path):
    points = points_of(spark, "rec", 4, 20)
    rows = spark.createDataFrame([("rec", *r[1:]) for r in metadata.rows_of("rec", ROOT)], metadata.ROWS)
    files.save_files(metadata.export_traces(points, rows), f"{tmp_path}/out", ".traces")
    got = metadata.read_metadata(spark, f"{tmp_path}/out").drop("dataset")
    key = lambda r: (r.scope, r.trace_id or 0, r.field)
    assert sorted(got.collect(), key=key) == sorted(rows.drop("dataset").collect(), key=key)
    back = legacy.read_recordings(spark, f"{tmp_path}/out").select("trace_id", "frame", "time_ms", "donor", "acceptor", "fret")
    assert sorted(back.collect()) == sorted(points.drop("dataset").collect())
    table = {r.trace_id: r for r in metadata.trace_table(rows).collect()}
    assert table[3].texts["ids"] == "movie#2" and table[3].numbers["scale"] == [2.0, 4.0] and table[3].sizes["m"] == [2, 3]


def test_metadata_follows_traces_into_several_files(spark, tmp_path):
    points = points_of(spark, "rec", 5, 3)
    rows = spark.createDataFrame([("rec", "trace", i, "ids", "char", [1, 2], None, f"t{i}") for i in range(1, 6)] + [("rec", "file", None, "dye", "char", [1, 3], None, "Cy3")], metadata.ROWS)
    files.save_files(metadata.export_traces(points, rows, most=2), f"{tmp_path}/out", ".traces")
    got = metadata.read_metadata(spark, f"{tmp_path}/out").select(F.regexp_extract("dataset", r"([^/]+)\.traces$", 1).alias("f"), "trace_id", "text").collect()
    assert sorted((r.f, r.trace_id or 0, r.text) for r in got) == [("rec", 0, "Cy3"), ("rec", 1, "t1"), ("rec", 2, "t2"), ("rec-2", 0, "Cy3"), ("rec-2", 1, "t3"), ("rec-2", 2, "t4"), ("rec-3", 0, "Cy3"), ("rec-3", 1, "t5")]


def test_a_folder_of_all_versions(spark, tmp_path):
    rng = np.random.default_rng(3)
    n, m = 3, 260
    time = 40.0 * np.arange(m)
    donor, acceptor = rng.integers(300, 500, (n, m)).astype(float), rng.integers(100, 300, (n, m)).astype(float)
    donor[:, 120:], acceptor[:, 120:] = rng.integers(0, 9, (n, m - 120)), rng.integers(0, 9, (n, m - 120))
    ids = [f"old {i}" for i in range(n)]
    channels = {"donor": donor, "acceptor": acceptor, "fret": np.round(acceptor / np.maximum(donor + acceptor, 1), 3)}
    for name, data in {"a": legacy.encode_paged(time, channels, ids, 3), "b": legacy.encode_paged(time, channels, ids, 4), "c": legacy.encode_counts(time, donor, acceptor, ids), "d": files.encode_traces(time, channels), "e": legacy.encode_counts(time, donor, acceptor, ids)[: -4 * m]}.items():
        (tmp_path / f"{name}.traces").write_bytes(data)
    got = legacy.read_recordings(spark, str(tmp_path)).withColumn("f", F.regexp_extract("dataset", r"(\w)\.traces$", 1)).toPandas().sort_values(["f", "trace_id", "frame"])
    assert len(got) == 5 * n * m
    for f in "abd":
        part = got[got.f == f]
        assert np.allclose(part.donor.to_numpy().reshape(n, m), donor) and np.allclose(part.fret.to_numpy().reshape(n, m), channels["fret"], atol=1e-6) and np.allclose(part.time_ms.to_numpy()[:m], time)
    raw = spark.createDataFrame([("c", i + 1, k + 1, float(time[k]), float(donor[i, k]), float(acceptor[i, k] - 0.05 * donor[i, k])) for i in range(n) for k in range(m)], "dataset string, trace_id long, frame int, time_ms double, donor double, acceptor double")
    want = project.fret_two(correct.subtract_background(project.fret_two(raw))).toPandas().sort_values(["trace_id", "frame"])
    for c in ("donor", "acceptor", "fret"):
        assert np.allclose(got[got.f == "c"][c].to_numpy(), want[c].to_numpy())
    assert got[got.f == "e"].time_ms.to_numpy()[:3].tolist() == [1, 2, 3]
    rows = metadata.read_metadata(spark, str(tmp_path)).filter("field = 'ids'").select(F.regexp_extract("dataset", r"(\w)\.traces$", 1).alias("f"), "trace_id", "text").collect()
    assert sorted((r.f, r.trace_id, r.text) for r in rows) == [(f, i + 1, ids[i]) for f in "abce" for i in range(n)]


def test_pages_under_sections():
    time, channels = np.arange(3.0), {c: np.ones((2, 3)) for c in ("donor", "acceptor", "fret")}
    data = legacy.encode_paged(time, channels, ["a", "b"])
    page = lambda title, code, many, raw: struct.pack("<B", len(title)) + title.encode() + struct.pack("<BI", code, many) + raw
    data += page("x", 9, 2, np.array([1.5, 2.5], "<f4").tobytes()) + page("section_heading", 0, 12, b"fileMetadata") + page("laser power", 4, 3, np.array([1, 2, 3], "<u2").tobytes())
    rows = {(r[1], r[2], r[3]): (r[4], r[6], r[7]) for r in metadata.rows_of("f", legacy.decode_any(data).root)}
    assert rows == {("file", None, "laser_power"): ("uint16", [1.0, 2.0, 3.0], None), ("trace", 1, "ids"): ("char", None, "a"), ("trace", 2, "ids"): ("char", None, "b"), ("trace", 1, "x"): ("single", [1.5], None), ("trace", 2, "x"): ("single", [2.5], None)}
    with pytest.raises(ValueError, match="section"):
        legacy.decode_any(legacy.encode_paged(time, channels, ["a", "b"]) + page("section_heading", 0, 5, b"other") + page("x", 9, 1, b"\0\0\0\0"))


def test_text_becomes_binary(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 2 3\n10 20 30\n1 2 3\n0.1 0.2 0.3\n11 21 31\n4 5 6\n0.4 0.5 0.6\n")
    files.save_files(legacy.text_to_binary(spark, str(tmp_path)).withColumn("dataset", F.lit("t")), f"{tmp_path}/out", ".traces")
    got = sorted((r.trace_id, r.frame, r.time_ms, r.donor, r.acceptor, round(r.fret, 6)) for r in legacy.read_recordings(spark, f"{tmp_path}/out").collect())
    assert got == [(1, 1, 1, 10, 1, 0.1), (1, 2, 2, 20, 2, 0.2), (1, 3, 3, 30, 3, 0.3), (2, 1, 1, 11, 4, 0.4), (2, 2, 2, 21, 5, 0.5), (2, 3, 3, 31, 6, 0.6)]


def test_files_go_to_known_stores_only(spark, tmp_path):
    named = spark.createDataFrame([("a/b", b"xyz")], "dataset string, content binary")
    files.save_files(named, f"file://{tmp_path}/x", ".bin")
    assert (tmp_path / "x" / "a_b.bin").read_bytes() == b"xyz"
    with pytest.raises(Exception, match="nosuch|scheme|filesystem"):
        files.save_files(named, "nosuch://host/x", ".bin")
