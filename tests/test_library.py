"""Properties, kernels, codecs, pipelines and streams of the trace library."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumatrace.functions import seq
from lumatrace.operators import combine, correct, dwell, fits, kernels, pixels, project, select, states, stats
from lumatrace.operators.kernels import Model, forward_backward, segmental_kmeans, usable, viterbi
from lumatrace.plans import pipelines, registry
from lumatrace.schema import KEYS
from lumatrace.sources import adapters, files
from lumatrace.streaming import ingest
from tests.conftest import SF


def points(spark, traces: dict[int, list[float]], dataset: str = "d"):
    rows = [(dataset, i, k + 1, 40.0 * k, 100.0 * (1 - x), 100.0 * x, float(x)) for i, xs in traces.items() for k, x in enumerate(xs)]
    return spark.createDataFrame(rows, "dataset string, trace_id long, frame int, time_ms double, donor double, acceptor double, fret double")


def idl(spark, traces: dict[int, list[int]]):
    return spark.createDataFrame([("d", i, k + 1, s) for i, xs in traces.items() for k, s in enumerate(xs)], "dataset string, trace_id long, frame int, state int")


def test_runs_of_exactly_five_are_dropped(spark):
    df = points(spark, {1: [0, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1]}).withColumn("on", F.col("fret") > 0)
    lit = [r.frame for r in seq.long_runs(df, "on", "lit").filter("lit").orderBy("frame").collect()]
    assert lit == list(range(8, 14))


def test_bounds_reject(spark):
    s = spark.createDataFrame([(1, 8.0), (2, 8.5), (3, None)], "trace_id int, snr double")
    assert [r.trace_id for r in select.pick(s, {"min_snr": 8, "odd_x": 1, "max_snr": None}).collect()] == [2]


def test_blinks(spark):
    path = [2] * 10 + [1] * 5 + [2] * 3 + [3] * 4 + [1] * 6
    got = [(r.state, r.n_frames) for r in dwell.remove_blinks(dwell.to_dwells(idl(spark, {1: path}))).orderBy("dwell_no").collect()]
    assert got == [(2, 18), (3, 4)]


def test_dwells_round_trip(spark):
    rng = np.random.default_rng(0)
    df = idl(spark, {i: rng.integers(0, 4, 40).tolist() for i in range(5)})
    back = dwell.to_states(dwell.to_dwells(df), df)
    assert back.exceptAll(df.select(*back.columns)).count() == 0 and df.select(*back.columns).exceptAll(back).count() == 0


def test_occupancy_sums_to_100(spark):
    df = idl(spark, {1: [1, 1, 2, 0], 2: [2, 3, 3, 3]})
    assert all(abs(r.s - 100) < 1e-9 for r in dwell.occupancy_by_frame(df).groupBy("frame").agg(F.sum("percent").alias("s")).collect())


def test_rescale_and_undo(spark):
    df = points(spark, {1: [0.1, 0.4, 0.7]})
    talk, scale = {("donor", "acceptor"): 0.07}, {"acceptor": 1.4, "donor": 0.9}
    back = correct.rescale(correct.rescale(df, talk, scale), {}, {}, (talk, scale))
    assert np.allclose(back.toPandas()[["donor", "acceptor"]], df.toPandas()[["donor", "acceptor"]])


def test_odd_traces_have_defined_statistics(spark):
    df = points(spark, {1: [0.5], 2: [0.0] * 30, 3: [0.4] * 30})
    got = stats.trace_stats(df).toPandas()
    assert len(got) == 3 and (got["lifetime"] == 0).all() and not got.isna().any().any()
    assert stats.trace_stats(df.limit(0)).count() == 0


def test_check_traces(spark):
    df = points(spark, {1: [0.1, 0.2], 2: [0.3]})
    assert project.check_traces(df) == {"missing_keys": 0, "repeated_frames": 0, "gaps": 0, "unequal_lengths": 1}
    assert project.check_traces(df.union(df))["repeated_frames"] == 2


def _enumerated(x, m):
    best = max(itertools.product(range(len(m.mu)), repeat=len(x)), key=lambda s: np.log(m.p0[s[0]]) + sum(np.log(m.a[a, b]) for a, b in itertools.pairwise(s)) + sum(-((v - m.mu[i]) ** 2) / 2 / m.sigma[i] ** 2 - np.log(m.sigma[i]) for v, i in zip(x, s, strict=True)))
    return [i + 1 for i in best]


def test_viterbi_against_all_paths():
    rng, m = np.random.default_rng(1), Model.of([0.1, 0.4, 0.8], [0.1, 0.12, 0.15], 0.8)
    for _ in range(10):
        x = rng.choice(m.mu, 6) + rng.normal(0, 0.12, 6)
        assert viterbi(x, m)[0].tolist() == _enumerated(x, m)
    assert viterbi(np.zeros(5), m)[0].tolist() == [0] * 5
    assert viterbi(np.array([0.4, 0.4, 0.4, 0, 0]), m)[0].tolist() == [2, 2, 2, 0, 0]


def test_forward_backward_against_all_paths():
    rng, m = np.random.default_rng(2), Model.of([0.2, 0.7], 0.2, 0.7)
    x = rng.normal(0.4, 0.3, 6)
    got = forward_backward(np.append(x, 1.0), m)
    p = lambda v, i: np.exp(-((v - m.mu[i]) ** 2) / 2 / m.sigma[i] ** 2) / np.sqrt(2 * np.pi) / m.sigma[i] / 100
    weights = {s: m.p0[s[0]] * np.prod([m.a[a, b] for a, b in itertools.pairwise(s)]) * np.prod([p(v, i) for v, i in zip(x, s, strict=True)]) for s in itertools.product(range(2), repeat=6)}
    total = sum(weights.values())
    assert np.isclose(got["ll"], np.log(total))
    assert np.allclose(got["g"], [sum(w * s.count(i) for s, w in weights.items()) / total for i in range(2)])
    assert np.allclose(got["xi"].sum(), 5)


def _simulated(n: int = 30, m: int = 120):
    rng, out, truth = np.random.default_rng(3), {}, {}
    for i in range(n):
        s = [int(rng.integers(0, 2))]
        while len(s) < m:
            s.append(s[-1] if rng.random() < 0.95 else 1 - s[-1])
        truth[i] = s
        out[i] = (np.array([0.3, 0.7])[s] + rng.normal(0, 0.05, m)).tolist()
    return out, truth


def test_truth_is_recovered(spark):
    traces, truth = _simulated()
    df, model = points(spark, traces), Model.of([0.2, 0.6], 0.1)
    for method in ("viterbi", "skm", "skm-joint", "bw"):
        got = states.idealize(df, model, method).toPandas()
        right = np.mean([truth[r.trace_id][r.frame - 1] + 1 == r.state for r in got.itertuples()])
        assert right > 0.97, method
    fitted, history = states.baum_welch(df, model, rounds=30)
    assert np.allclose(fitted.mu, [0.3, 0.7], atol=0.01) and np.allclose(fitted.sigma, 0.05, atol=0.01)
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(history))


def test_skm_of_one_trace():
    x = np.array([0.3] * 20 + [0.8] * 20) + np.random.default_rng(4).normal(0, 0.03, 40)
    path, m, _ = segmental_kmeans(x, Model.of([0.2, 0.9], 0.1))
    assert path.tolist() == [1] * 20 + [2] * 20 and np.allclose(m.mu, [0.3, 0.8], atol=0.02)


def test_gaussian_center():
    x = np.arange(-0.1, 0.26, 0.01)
    b, c = select.gaussian_center(x, np.exp(-(((x - 0.08) / 0.03) ** 2)))
    assert abs(b - 0.08) < 1e-6 and abs(c - 0.03) < 1e-6


def test_trace_files(spark, tmp_path):
    rng = np.random.default_rng(5)
    channels = {c: rng.random((4, 20)).astype("<f4").astype(float) for c in ("donor", "acceptor", "fret")}
    (tmp_path / "t5.traces").write_bytes(files.encode_traces(np.arange(20) * 40.0, channels))
    df = files.read_traces(spark, str(tmp_path))
    got = df.orderBy("trace_id", "frame").toPandas()
    assert len(got) == 80 and np.allclose(got["fret"], channels["fret"].ravel())
    assert {r.trace_id for r in files.read_traces(spark, str(tmp_path), [2, 3, 99]).collect()} == {2, 3}
    assert files.size_catalog(spark, str(tmp_path)).first()[1:] == (4, 20, ["donor", "acceptor", "fret"])
    again = files.export_traces(df).first().content
    assert np.allclose(files.decode_traces(bytes(again))[1]["donor"], channels["donor"])


def test_dwell_files(spark, tmp_path):
    d = dwell.to_dwells(idl(spark, {1: [1, 1, 2, 2, 2], 2: [3, 3, 1]}))
    text = files.dwell_text(d, [(0.0, 0.1), (0.4, 0.1), (0.7, 0.1)], 40.0).first().value
    (tmp_path / "a.qub.dwt").write_text(text + "Segment: 3 Dwells: 0 Sampling(ms): 40 Start(ms): 0 ClassCount: 3 0 0.1 0.4 0.1 0.7 0.1\n")
    got = [(r.segment, r.state, r.n_frames) for r in files.read_dwells(spark, str(tmp_path)).orderBy("segment", "dwell_no").collect()]
    assert got == [(1, 1, 2), (1, 2, 3), (2, 3, 2), (2, 1, 1)]


def test_legacy_text_and_lists(spark, tmp_path):
    (tmp_path / "l.txt").write_text("0 40 80\nx_1 1 2 3\nx_1 4 5 6\nx_1 0.1 0.2 0.3\n7 8 9\n1 1 1\n0 0 0\n")
    got = files.read_legacy_text(spark, str(tmp_path / "l.txt")).orderBy("trace_id", "frame").toPandas()
    assert got["donor"].tolist() == [1, 2, 3, 7, 8, 9] and got["time_ms"].tolist() == [0, 40, 80] * 2
    (tmp_path / "sel.txt").write_text("1 3 4\n")
    assert sorted(r.trace_id for r in files.selection_list(spark, str(tmp_path / "sel.txt")).collect()) == [1, 3, 4]


def test_movies(spark, tmp_path):
    v = np.random.default_rng(6).integers(0, 60_000, (5, 16, 16)).astype("<u2")
    (tmp_path / "m.pma").write_bytes(np.array([16, 16], "<u2").tobytes() + v.tobytes())
    px = files.read_movie(spark, str(tmp_path))
    got = px.orderBy("frame", "y", "x").toPandas()["intensity"].to_numpy()
    assert np.array_equal(got, v.ravel().astype(float))
    assert files.concatenated(px.union(px.withColumn("movie", F.lit("z"))), "all").agg(F.max("frame")).first()[0] == 10


def test_companions(spark):
    t = spark.createDataFrame([("a.traces",), ("b.traces",), ("c.traces",)], "path string")
    d = spark.createDataFrame([("a.dwt",), ("a.qub.dwt",), ("b.dwt",)], "path string")
    assert {r.path: r.dwell_path for r in files.with_companions(t, d).collect()} == {"a.traces": "a.qub.dwt", "b.traces": "b.dwt", "c.traces": None}
    with pytest.raises(FileNotFoundError):
        files.with_companions(t, d, required=True)


def test_alignment(spark):
    rng = np.random.default_rng(7)
    xy = rng.random((60, 2)) * 100
    moved = xy @ np.array([[1.01, 0.01], [-0.01, 0.99]]).T + [1.5, -0.8]
    df = lambda p: spark.createDataFrame([("m", i, float(x), float(y)) for i, (x, y) in enumerate(p)], "movie string, id long, x double, y double")
    t = pixels.align(df(xy), df(moved), 9.0, ["movie"], rounds=20)
    assert np.allclose(t, [[1.01, 0.01, 1.5], [-0.01, 0.99, -0.8]], atol=0.02)


def test_combine_is_associative(spark):
    a, b, c = (points(spark, {1: [0.1] * n, 2: [0.2] * n}, d) for d, n in (("a", 4), ("b", 3), ("c", 5)))
    one = combine.combine([combine.combine([a, b], "x"), c], "y").toPandas()
    two = combine.combine([a, combine.combine([b, c], "x")], "y").toPandas()
    key = ["trace_id", "frame", "fret"]
    assert one[key].sort_values(key).values.tolist() == two[key].sort_values(key).values.tolist()


def _bright(spark, n: int = 6):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        for k in range(200):
            on = k < 120
            d, a = (500, 400 if (k // 30) % 2 else 150) if on else (0, 0)
            d, a = d + rng.normal(0, 8), a + rng.normal(0, 8)
            rows.append(("d", i, k + 1, 40.0 * k, float(d), float(a), float(a / (d + a)) if on else 0.0))
    return spark.createDataFrame(rows, "dataset string, trace_id long, frame int, time_ms double, donor double, acceptor double, fret double")


def test_select_pipeline_and_stream(spark, tmp_path):
    df = _bright(spark)
    loose = {"eq_overlap": 0, "min_snr": 8, "min_acclife": 15}
    picked, log = pipelines.select_traces([df], loose)
    assert picked.select(*KEYS).distinct().count() == log.first().picked == 6
    pipelines.save(df.filter("trace_id < 3"), str(tmp_path / "in"))
    pipelines.save(df.filter("trace_id < 3"), str(tmp_path / "flat"))
    flat = df.filter("trace_id < 3")
    flat.write.mode("overwrite").parquet(str(tmp_path / "flat"))
    args = (spark, str(tmp_path / "flat"), flat.schema, str(tmp_path / "out"), str(tmp_path / "ck"), loose, None)
    for _ in range(2):  # the second run finds nothing new
        ingest.auto_select(*args).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("trace_id").distinct().count() == 3


def test_delivery_and_summary(spark):
    df = _bright(spark, 4)
    out = pipelines.delivery(df, {"min_snr": 8})
    assert out["split"].filter("productive").count() == 4
    s = pipelines.summary(df, out["states"], 40.0)
    assert abs(s["contour"].filter("frame = 1").agg(F.sum("share")).first()[0] - 1) < 1e-9
    assert isinstance(s["rates"].toPandas(), pd.DataFrame)


def test_circle_through_edge_points(spark):
    rng = np.random.default_rng(9)
    a = rng.random(40) * 2 * np.pi
    rows = [("d", i, 500 + 240 * float(np.cos(t)), 480 + 240 * float(np.sin(t))) for i, t in enumerate(a)] + [("d", 100 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((12, 2)) * 1000)]
    got = select.fit_circles(spark.createDataFrame(rows, "dataset string, id long, x double, y double"), ["dataset"], 200).first()
    assert abs(got.cx - 500) < 3 and abs(got.cy - 480) < 3 and abs(got.r - 240) < 3 and got.inliers >= 40


def test_flat_field_is_recovered(spark):
    rng, c = np.random.default_rng(10), [1.0, 0.3, -0.2, 0.1, 0.05, -0.1]
    xy = rng.random((80, 2)) * 1000
    r = [c[0] + c[1] * x + c[2] * y + c[3] * x * x + c[4] * x * y + c[5] * y * y for x, y in xy / 1000]
    df = spark.createDataFrame([("d", i, k + 1, 100.0, 100.0 * float(v), float(v / (1 + v))) for i, v in enumerate(r) for k in range(25)], "dataset string, trace_id long, frame int, donor double, acceptor double, fret double")
    places = spark.createDataFrame([("d", i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "dataset string, trace_id long, donor_x double, donor_y double")
    assert np.allclose(np.array(correct.flat_field(df, places)) * np.mean(r), c, atol=1e-6)


def test_extraction(spark):
    rows = []
    for f in range(1, 13):
        for y in range(9):
            for x in range(18):
                v = 10.0
                if (x, y) in ((4, 4), (13, 4)):
                    v = 100.0 if x < 9 else 60.0 + f
                rows.append(("m", f, 1 if x < 9 else 2, y, x, v))
    got = pixels.extract(spark.createDataFrame(rows, "movie string, frame int, channel int, y int, x int, intensity double"), 50.0, 1, 4, 2).orderBy("frame").toPandas()
    assert len(got) == 12 and got["donor"].tolist() == [130.0] * 12 and got["acceptor"].tolist() == [90.0 + f for f in range(1, 13)]


# --- registered queries do the whole job -------------------------------------------------------------------------------


def _joined(spark):
    rows = adapters.event_traces(spark, SF).select("trace_id", "frame", "fret").toPandas().sort_values(["trace_id", "frame"])
    return {int(t): g.fret.fillna(0).to_numpy() for t, g in rows.groupby("trace_id")}


def _agree(spark, name, model, traces):
    got = registry.QUERIES[name](spark, SF).toPandas().sort_values(["trace_id", "frame"])
    want = np.concatenate([viterbi(x, model)[0] for _, x in sorted(traces.items())])
    assert len(got) == len(want) and (got.state.to_numpy() == want).all()


def test_h6_runs_to_convergence_or_the_reference_limit(spark):
    traces, m, history = _joined(spark), registry._three(), []
    while len(history) < 200 and (len(history) < 2 or abs(history[-1] - history[-2]) > 1e-5):
        sums = [r for x in traces.values() if (r := forward_backward(np.clip(x, -0.5, 1.5), m))]
        total = {k: sum(r[k] for r in sums) for k in ("ll", "g1", "xi", "g", "gx", "gxx")}
        history.append(total["ll"] / len(traces))
        mu = total["gx"] / total["g"]
        sigma = np.maximum(0.01, np.sqrt(np.maximum(0, total["gxx"] / total["g"] - mu**2)))
        m = Model(total["g1"] / total["g1"].sum(), mu, sigma, total["xi"] / total["xi"].sum(axis=1, keepdims=True))
    assert len(history) > 5
    print("h6 rounds", len(history), "last change", history[-1] - history[-2])
    _agree(spark, "h6_baum_welch", m, traces)


def test_h4_runs_to_convergence(spark):
    traces, m, last, rounds = _joined(spark), registry._three(), -np.inf, 0
    while True:
        k, p0, a, xs, ss, ll = 3, np.full(3, 0.01), 0.01 * np.eye(3), [], [], 0.0
        for x in traces.values():
            s, one = viterbi(x, m)
            n = usable(x)
            if n > 1:
                s, ll = s[:n] - 1, ll + one * n
                p0[s[0]] += 1
                np.add.at(a, (s[:-1], s[1:]), 1)
                xs.append(x[:n])
                ss.append(s)
        x, s = np.concatenate(xs), np.concatenate(ss)
        mu = np.array([x[s == i].mean() if (s == i).any() else m.mu[i] for i in range(k)])
        sigma = np.array([max(0.01, x[s == i].std(ddof=1)) if (s == i).sum() > 1 else m.sigma[i] for i in range(k)])
        m, rounds = Model(p0 / p0.sum(), mu, sigma, a / a.sum(axis=1, keepdims=True)), rounds + 1
        if abs(ll / len(x) - last) < 1e-4:
            break
        last = ll / len(x)
        assert rounds < 100
    assert rounds > 5
    _agree(spark, "h4_fit_jointly", m, traces)


def test_exports_hold_every_trace_and_frame(spark):
    traces = _joined(spark)
    frames = sum(map(len, traces.values()))
    for name in ("a11_text_lines", "c14_whole_bins"):
        out = registry.QUERIES[name](spark, SF).select("trace_id", "frame").distinct()
        assert out.count() == frames and out.select("trace_id").distinct().count() == len(traces)


def test_c18_finds_a_ring_as_closely_as_the_reference(spark, monkeypatch):
    angle = np.linspace(0, 2 * np.pi, 800, endpoint=False)
    rows = [("d", i, float(500 + 240 * np.cos(t)), float(480 + 240 * np.sin(t))) for i, t in enumerate(angle)]
    monkeypatch.setattr(registry.A, "positioned", lambda points: spark.createDataFrame(rows, "dataset string, trace_id long, donor_x double, donor_y double"))
    got = registry.QUERIES["c18_fit_circles"](spark, SF).first()
    assert abs(got.cx - 500) < 4 and abs(got.cy - 480) < 4 and abs(got.r - 240) < 4 and got.inliers >= 80


def test_dark_class_does_not_count(spark):
    df = idl(spark, {1: [1], 2: [1], 3: [2], 4: [3]})
    for got in (dwell.occupancy_by_frame(df), dwell.percent_time(df)):
        assert {r.state: r.percent for r in got.collect()} == {2: 50.0, 3: 50.0}
    assert {r.state: r.percent for r in dwell.percent_time(df, hide_dark=False).collect()} == {1: 50.0, 2: 25.0, 3: 25.0}


def test_three_colors_without_a_long_run_and_with_a_dark_donor(spark):
    rng = np.random.default_rng(1)
    rows = [("d", 1, k + 1, 40.0 * k, 78.0, 12.0, 10.0) for k in range(60)]  # fret 0.22 throughout: no run at 0.25
    rows += [("d", 2, k + 1, 40.0 * k, *((50.0, 30.0, 20.0) if k < 40 else rng.normal(0, 1, 3).tolist())) for k in range(80)]
    df = spark.createDataFrame([tuple(map(lambda v: float(v) if isinstance(v, (float, np.floating)) else v, r)) for r in rows], "dataset string, trace_id long, frame int, time_ms double, donor double, acceptor double, acceptor2 double")
    got = {(r.trace_id, r.frame): (r.fret, r.fret2) for r in project.fret_three(df, "tandem3").collect()}
    assert all(abs(got[1, k][0] - 0.22) < 1e-9 and abs(got[1, k][1] - 10 / 22) < 1e-9 for k in range(1, 55))
    assert all(got[2, k] == (0, 0) for k in range(45, 81)) and abs(got[2, 10][0] - 0.5) < 1e-9 and abs(got[2, 10][1] - 0.4) < 1e-9


def test_dwell_autocovariance_of_one_state(spark):
    rows, want = [], []
    for t in range(3):
        own = [2 + (k * (t + 1)) % 7 for k in range(24)]
        for k, n in enumerate(own):
            rows += [("d", t, 2 * k + 1, 2, 1, n), ("d", t, 2 * k + 2, 3, 1, 100 + k)]
        x = np.array(own) - np.mean(own)
        want.append([float((x[: len(x) - lag] * x[lag:]).sum() / (x @ x)) for lag in range(25)])
    df = spark.createDataFrame(rows, "dataset string, trace_id long, dwell_no int, state int, start_frame int, n_frames int")
    got = {r.lag: (r.mean, r.n) for r in dwell.autocovariance(df, 2).collect()}
    assert sorted(got) == list(range(25)) and all(abs(got[lag][0] - np.mean([w[lag] for w in want])) < 1e-9 and got[lag][1] == 3 for lag in got)
    assert dwell.autocovariance(df, 2, least=24).count() == 0
    y0, a, k = dwell.autocovariance_fit(spark.createDataFrame([("d", lag, 0.005 + 0.4 * float(np.exp(-0.3 * lag))) for lag in range(50)], "dataset string, lag int, mean double"))["d"]
    assert abs(y0 - 0.005) < 1e-6 and abs(a - 0.4) < 1e-6 and abs(k - 0.3) < 1e-6


def test_lifetimes_are_fitted(spark):
    x = np.arange(200) * 0.04
    a, tau, r2 = fits.exponential(x, 0.9 * np.exp(-x / 1.3))
    assert abs(a - 0.9) < 1e-6 and abs(tau - 1.3) < 1e-6 and r2 > 1 - 1e-9
    assert all(np.isnan(v) for v in fits.exponential(x[:1], x[:1]))
    y = np.exp(-x / 0.8) + np.random.default_rng(2).normal(0, 0.02, len(x))
    _, tau, _ = fits.exponential(x, y)
    grid = np.linspace(0.5, 1.2, 7001)
    e = np.exp(-x[None, :] / grid[:, None])
    best = (e @ y / (e * e).sum(axis=1))[:, None] * e
    assert abs(tau - grid[((y - best) ** 2).sum(axis=1).argmin()]) < 2e-4


def test_log_histogram_is_in_percent(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("d", 1, k + 1, 2 + k % 2, 1, int(n)) for k, n in enumerate(rng.integers(1, 40, 300))], "dataset string, trace_id long, dwell_no int, state int, start_frame int, n_frames int")
    total = lambda how: {r.state: round(r.v, 6) for r in dwell.log_histogram(df, 40.0, normalize=how).groupBy("state").agg(F.sum("value").alias("v")).collect()}
    assert total("state") == {2: 100.0, 3: 100.0} and total("file") == {2: 50.0, 3: 50.0} and total("off") == {2: 150.0, 3: 150.0}


def test_transitions_close_up_before_they_are_cut(spark):
    df = idl(spark, {1: [2, 1, 1, 3, 2, 3]})
    row = dwell.transition_events(df, 3).collect()[0]
    assert (row.events, row.n_frames) == (2, 3)


def test_titles(spark):
    titles = lambda *paths: {r.path: r.title for r in project.trim_titles(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert titles("/a/run_1 low_auto.traces", "/b/run_1 high_auto.traces") == {"/a/run_1 low_auto.traces": "low", "/b/run_1 high_auto.traces": "high"}
    assert titles("/a/one_two.txt") == {"/a/one_two.txt": "one two"}
    assert titles("/a/x.txt", "/b/x.txt") == {"/a/x.txt": "1", "/b/x.txt": "2"}
    assert titles("a b.txt", "a c b.txt") == {"a b.txt": "-", "a c b.txt": "c"}


def test_ensemble_value_and_within_sigma(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([("d", i, float(v)) for i, v in enumerate(rng.normal(0.12, 0.02, 4000))], "dataset string, trace_id long, k double")
    assert abs(correct.ensemble_value(df, "k", -0.1, 0.01, 36) - 0.12) < 0.002
    assert abs(correct.ensemble_value(df, "k", -0.1, 0.01, 36, use_median=True) - 0.12) < 0.002
    st = spark.createDataFrame([(i, float(v)) for i, v in enumerate([*rng.normal(500, 40, 3000), -5.0, 0.0, 900.0])], "trace_id long, t double")
    kept = {r.trace_id for r in select.within_sigma(st, 2.0).collect()}
    assert len(kept) > 2950 and not {3000, 3001, 3002} & kept


def test_bootstrap_of_any_statistic(spark):
    rng = np.random.default_rng(5)
    x = rng.poisson(20, 400)
    each = spark.createDataFrame([("d", i, int(v), 10) for i, v in enumerate(x)], "dataset string, trace_id long, events int, seconds int")
    se = dwell.bootstrap_se(each, F.col("events") / F.col("seconds"), 400).collect()[0].se
    assert abs(se - x.std() / 10 / np.sqrt(len(x))) < 0.25 * se


def test_donor_alive_and_ensemble_model(spark):
    rng = np.random.default_rng(6)
    level = [1000.0] * 30 + [0.0] * 10 + [1000.0] * 30 + [0.0] * 40
    rows = [("d", i, k + 1, 40.0 * k, float(v / 2 + rng.normal(0, 20)), float(v / 2 + rng.normal(0, 20)), 0.5) for i in range(4) for k, v in enumerate(level)]
    df = spark.createDataFrame(rows, "dataset string, trace_id long, frame int, time_ms double, donor double, acceptor double, fret double")
    alive = states.donor_alive(df).groupBy("frame").agg(F.sum(F.col("alive").cast("int")).alias("n")).orderBy("frame").toPandas().n.to_numpy()
    assert (alive[2:28] == 4).all() and (alive[31:39] == 0).all() and (alive[72:] == 0).all()
    two = points(spark, {i: [0.2] * 40 + [0.7] * 40 for i in range(3)}).withColumn("fret", F.col("fret") + F.rand(1) * 0.02 - 0.01)
    model = {r.state: r.mu for r in states.ensemble_model(states.fit_each(two, Model.of([0.3, 0.6], 0.1))).collect()}
    assert abs(model[1] - 0.2) < 0.01 and abs(model[2] - 0.7) < 0.01


def test_kernels_over_many_traces():
    """Batches of traces of all lengths give what each gives alone; joint sums are the sums of each."""
    rng = np.random.default_rng(11)
    xs = [np.where(rng.random(n) < 0.5, 0.2, 0.7) + rng.normal(0, 0.1, n) for n in (0, 1, 2, 5, 6, 40, 40, 300)] + [np.zeros(9)]
    xs.append(np.concatenate([xs[5], np.zeros(7)]))
    m = Model.of([0.0, 0.3, 0.7], 0.1)
    for (many, ll), x in zip(kernels.viterbi_all(xs, m), xs, strict=True):
        alone, own = kernels.viterbi(x, m)
        assert (many == alone).all() and (ll == own or (np.isnan(ll) and np.isnan(own)))
    for (many, model, ll), x in zip(kernels.segmental_kmeans_all(xs, m), xs, strict=True):
        alone, own, best = kernels.segmental_kmeans(x, m)
        assert (many == alone).all() and np.allclose(model.mu, own.mu) and np.allclose(model.a, own.a) and (ll == best or np.isnan(best))
    each = [r for r in (kernels.forward_backward(x, m) for x in xs) if r is not None]
    total = kernels.forward_backward_all(xs, m)
    assert len(each) == 5 and all(np.allclose(total[k], sum(r[k] for r in each)) for k in total)
    assert kernels.forward_backward_all([], m) is None and kernels.viterbi_all([], m) == []


def test_ranks(spark, monkeypatch):
    """Percentiles equal Spark's in small and large groups, null, empty and tied ones; numbers run through blocks."""
    from lumatrace.functions import ranks

    monkeypatch.setattr(ranks, "ACCURACY", 500)
    monkeypatch.setattr(ranks, "BLOCK", 100)
    v = F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 5 == 0, 7.5).otherwise(F.round(F.randn(3) * 50, 2))
    df = spark.range(0, 20_000, 1, 4).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), v.alias("v"))
    df = df.unionByName(spark.createDataFrame([("one", 5.0), ("none", None), (None, 1.0), (None, 2.0)], "g string, v double")).persist()
    for q in (0.0, 0.05, 0.5, 0.75, 0.99, 1.0):
        want = {r.g: r[1:] for r in df.groupBy("g").agg(F.percentile("v", q), F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY v)")).collect()}
        got = {r.g: r.x for r in ranks.percentile(df, ["g"], "v", q, "x").collect()}
        first = {r.g: r.x for r in ranks.percentile(df, ["g"], "v", q, "x", discrete=True).collect()}
        assert got.keys() == want.keys() and first == {g: w[1] for g, w in want.items()}
        assert all(got[g] == pytest.approx(w[0], abs=1e-9) for g, w in want.items() if w[0] is not None) and got["none"] is None
    assert ranks.percentile(df, [], "v", 0.5, "x").first().x == pytest.approx(df.agg(F.percentile("v", 0.5)).first()[0])
    assert ranks.percentile(df.filter("false"), ["g"], "v", 0.5, "x").collect() == []
    ids = spark.range(0, 3000).select(F.lit("d").alias("dataset"), (F.col("id") * 7 - 500).alias("trace_id")).union(spark.createDataFrame([("e", None), ("e", 4), (None, 9)], "dataset string, trace_id long"))
    n = ranks.numbered(ids, ["dataset"], "trace_id", "n")
    assert n.columns == ["dataset", "trace_id", "n"] and n.filter("dataset = 'd'").filter("n = (trace_id + 500) / 7 + 1").count() == 3000
    assert {(r.dataset, r.trace_id, r.n) for r in n.filter("dataset is null or dataset = 'e'").collect()} == {("e", None, 1), ("e", 4, 2), (None, 9, 1)}


def test_files_of_bounded_size(spark, tmp_path):
    rows = [("d", t, f, 40.0 * (f - 1), 1.0 * t, 2.0, 0.5) for t in (3, 5, 9, 11, 20) for f in (1, 2, 3)]
    df = spark.createDataFrame(rows, "dataset string, trace_id long, frame int, time_ms double, donor double, acceptor double, fret double")
    parts = {r.dataset: files.decode_traces(bytes(r.content))[1]["donor"][:, 0].tolist() for r in files.export_traces(df, most=2).collect()}
    assert parts == {"d": [3, 5], "d-2": [9, 11], "d-3": [20]}
    d = dwell.to_dwells(idl(spark, {1: [1, 1, 2], 2: [3, 1], 7: [2]}))
    text = {r.dataset: r.value for r in files.dwell_text(d, [(0.0, 0.1), (0.4, 0.1), (0.7, 0.1)], 40.0, most=2).collect()}
    assert len(text) == 2 and [t.count("Segment: 1 ") for t in text.values()] == [1, 1] and sorted(t.count("Segment:") for t in text.values()) == [1, 2]


def test_streamed_summary_adds_up_over_batches(spark, tmp_path):
    """A dataset in three files, taken one file a batch, gives the contour and histogram of the whole."""
    from lumatrace.operators import ensemble

    rows = [("d" if t < 7 else "e", t, f, 0.1 * ((t + f) % 9)) for t in range(10) for f in range(1, 6)]
    df = spark.createDataFrame(rows, "dataset string, trace_id long, frame int, fret double")
    for i in range(3):
        df.filter(F.col("trace_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    ingest.auto_summary(spark, str(tmp_path / "in"), df.schema, out, str(tmp_path / "ck"), None, files_a_batch=1).awaitTermination(120)
    got = ingest.summary_so_far(spark, out)
    for name, want in (("contour", ensemble.contour(df)), ("histogram", ensemble.fret_histogram(df))):
        rounded = [{tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.collect()} for t in (got[name], want)]
        assert rounded[0] == rounded[1] and rounded[0]
    assert spark.read.parquet(f"{out}/traces").select("batch").distinct().count() == 3


def test_in_circles(spark):
    places = spark.createDataFrame([("d", 1, 10.0, 10.0), ("d", 2, 300.0, 10.0), ("e", 1, -40.0, 5.0), ("d", 3, 900.0, 900.0), ("d", 4, None, 1.0)], "dataset string, trace_id long, donor_x double, donor_y double")
    circles = [("A", 0.0, 0.0, 290.0), ("B", 290.0, 0.0, 300.0)]
    shape = "quadrant string, cx double, cy double, r double"
    got = select.in_circles(places, spark.createDataFrame(circles, shape))
    assert got.columns == ["dataset", "trace_id", "donor_x", "donor_y", "quadrant"]
    assert {(r.dataset, r.trace_id, r.quadrant) for r in got.collect()} == {("d", 1, "A"), ("e", 1, "A"), ("d", 1, "B"), ("d", 2, "B")}
    own = select.in_circles(places, spark.createDataFrame([("e", *circles[0])], "dataset string, " + shape))
    assert [(r.dataset, r.trace_id) for r in own.collect()] == [("e", 1)]


def test_streamed_extraction_equals_a_batch_one(spark, tmp_path):
    """Two movies, a file each: streaming writes what extraction gives for each movie; a second run adds nothing."""
    shape = "movie string, frame int, channel int, y int, x int, intensity double"
    whole = []
    for name, peak in (("m", 100.0), ("k", 70.0)):
        lit = {(4, 4): lambda f, p=peak: p if f < 40 else 10.0, (13, 4): lambda f: 60.0 if f < 30 else 10.0}
        rows = [(name, f, 1 if x < 9 else 2, y, x, float(lit[x, y](f)) if (x, y) in lit else 10.0 + (x + y + f) % 2) for f in range(1, 61) for y in range(9) for x in range(18)]
        whole.append(spark.createDataFrame(rows, shape))
        whole[-1].coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):
        ingest.auto_extract(spark, str(tmp_path / "in"), whole[0].schema, out, str(tmp_path / "ck"), 50.0, None).awaitTermination(120)
    want = pipelines.extract_traces(whole[0].union(whole[1]), 50.0)
    got = spark.read.parquet(out).select(*want.columns)
    assert want.select(*KEYS).distinct().count() == 2 and want.count() == got.count()
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_dye_diagnostics(spark):
    """Five of six traces lie in the field's middle; each is lit for 120 of 200 frames of 40 ms."""
    df = _bright(spark)
    places = spark.createDataFrame([("d", i, *((1000.0, 1000.0) if i == 0 else (500.0, 450.0))) for i in range(6)], "dataset string, trace_id long, donor_x double, donor_y double")
    got = pipelines.dye_diagnostics(df, places, 40.0).collect()
    assert len(got) == 1
    r = got[0]
    lit = df.filter("trace_id > 0 and frame <= 120").agg(F.sum(F.col("donor") + F.col("acceptor"))).first()[0] / 5
    assert r.mean_on == pytest.approx(4.8, rel=0.02) and r.total_on == pytest.approx(4.8, rel=0.02) and r.mean_off == pytest.approx(3.2, rel=0.03)
    assert r.percent_on == pytest.approx(60, rel=0.02) and r.photons == pytest.approx(lit, rel=0.02)
