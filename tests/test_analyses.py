"""Fits by group, dyes, errors of histograms, lagged sums, reviews and numbering against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumatrace.functions import ranks, seq
from lumatrace.operators import dwell, dyes, ensemble, fits, reviews
from lumatrace.plans import pipelines, registry
from tests.conftest import SF


def plain_gaussian(x, y):
    """A nested grid over center and width; the height is known for each."""
    best = (np.inf, 0, 0, 0)
    lo, hi = (x.min(), np.diff(x).min() / 3), (x.max(), np.ptp(x) * 2)
    for _ in range(12):
        bs, cs = np.linspace(lo[0], hi[0], 25), np.linspace(lo[1], hi[1], 25)
        for b in bs:
            for c in cs:
                e = np.exp(-(((x - b) / c) ** 2))
                a = e @ y / (e @ e)
                loss = ((y - a * e) ** 2).sum()
                if loss < best[0]:
                    best = (loss, a, b, c)
        w = ((hi[0] - lo[0]) / 8, (hi[1] - lo[1]) / 8)
        lo, hi = (best[2] - w[0], max(best[3] - w[1], 1e-6)), (best[2] + w[0], best[3] + w[1])
    return best[1:]


def test_gaussians_of_all_groups(spark):
    rng, rows, curves = np.random.default_rng(1), [], {}
    x = -3 + 0.3 * np.arange(27)
    for g in range(6):
        y = (0.2 + g) * np.exp(-(((x - (g - 2) * 0.7) / (0.5 + 0.2 * g)) ** 2)) + rng.random(27) * 0.03
        curves[f"g{g}"] = y
        rows += [(f"g{g}", i + 1, float(v)) for i, v in enumerate(y)]
    rows += [("few", 3, 1.0), ("few", 4, 2.0)]
    got = {r.g: r for r in fits.gaussian_fits(spark.createDataFrame(rows, "g string, b int, y double"), ["g"], "b", "y", -3.0, 0.3, 27).collect()}
    assert (got["few"].center, got["few"].width) == (None, None)
    for g, y in curves.items():
        assert np.allclose((got[g].height, got[g].center, got[g].width), plain_gaussian(x, y), atol=2e-3)


def dwells_of(spark, runs):
    rows = []
    for (d, t), pairs in runs.items():
        at = 1
        for k, (state, n) in enumerate(pairs, start=1):
            rows.append((d, t, k, state, at, n))
            at += n
    return spark.createDataFrame(rows, "dataset string, trace_id long, dwell_no int, state int, start_frame int, n_frames int")


def made_dwells(spark, traces=60, seed=2):
    rng = np.random.default_rng(seed)
    return dwells_of(spark, {("d", t): [(1 + k % 2, int(rng.geometric(0.2 if k % 2 else 0.05))) for k in range(int(rng.integers(3, 30)))] for t in range(traces)})


def test_rate_peaks_are_near_the_rates_that_made_the_dwells(spark):
    got = {(r.src, r.dst): r for r in dwell.rate_peaks(dwell.log_rate_histogram(made_dwells(spark, 300), 40.0)).collect()}
    assert got[1, 2].k == pytest.approx(0.05 / 0.04, rel=0.35) and got[2, 1].k == pytest.approx(0.2 / 0.04, rel=0.35)
    assert got[1, 2].n_traces <= 300


def test_waiting_times(spark):
    df = made_dwells(spark, 200)
    curve = dwell.waiting_curve(df).toPandas()
    rows = df.toPandas().sort_values(["trace_id", "dwell_no"])
    before = rows.iloc[:-1][rows.trace_id.to_numpy()[:-1] == rows.trace_id.to_numpy()[1:]]
    for src in (1, 2):
        own = curve[curve.src == src].sort_values("frame")
        n = before[before.state == src].n_frames.to_numpy()
        assert own.left.tolist() == [int((n > f).sum()) for f in range(100)]
    k = {r.src: r.k for r in dwell.waiting_fits(dwell.waiting_curve(df), 40.0).collect()}
    assert k[1] == pytest.approx(-np.log(0.95) / 0.04, rel=0.1) and k[2] == pytest.approx(-np.log(0.8) / 0.04, rel=0.1)


def test_time_to_a_state_on_a_grid(spark):
    df = dwells_of(spark, {("d", 1): [(1, 10), (3, 30)], ("d", 2): [(3, 5), (1, 5), (3, 25)], ("d", 3): [(1, 50)], ("d", 4): [(3, 25)]})
    n = spark.createDataFrame([("d", 4), ("e", 3)], "dataset string, n_traces long")
    got = {(r.dataset, r.frame): (r.seconds, r.reached) for r in dwell.time_to_state_curve(df, n, until=2.0).collect()}
    assert len(got) == 2 * 51 and got["d", 0] == (0, 0.25) and got["d", 9][1] == 0.25 and got["d", 10] == (0.4, 0.75) and got["d", 50] == (2, 0.75) and got["e", 50] == (2, 0)


def test_the_covariance_fit_counts_from_lag_one_and_missing_lags_as_zero(spark):
    lag = np.arange(50)
    rows = [("d", int(i), float(0.005 + 0.4 * np.exp(-0.3 * i))) for i in lag] + [("short", int(i), float(0.4 * np.exp(-0.5 * i))) for i in lag[:20]]
    got = dwell.autocovariance_fit(spark.createDataFrame(rows, "dataset string, lag int, mean double"))
    assert np.allclose(got["d"], (0.005, 0.4, 0.3), atol=1e-6)
    y = np.r_[0.4 * np.exp(-0.5 * lag[1:20]), np.zeros(30)]
    assert np.allclose(got["short"], fits.decay_to_offset(lag[1:].astype(float), y))


def test_lagged_sums(spark):
    rng, rows, want = np.random.default_rng(3), [], {}
    for t, n in enumerate((1, 2, 7, 60)):
        a, b = rng.random(n), rng.random(n)
        rows += [("d", t, 3 * i + 1, float(a[i]), float(b[i])) for i in range(n)]
        x, y = a - a.mean(), b - b.mean()
        for lag in range(min(n, 11)):
            norm = np.sqrt((x @ x) * (y @ y))
            want[t, lag] = (x[lag:] @ y[: n - lag]) / norm if norm else None
    df = spark.createDataFrame(rows, "dataset string, trace_id long, frame int, a double, b double")
    out = seq.cross_correlation(df, "a", "b", 10)
    got = {(r.trace_id, r.lag): r.value for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] is None if v is None else abs(got[k] - v) < 1e-9 for k, v in want.items())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1  # all lags in one ordering of each trace


def test_errors_of_histograms(spark):
    rng = np.random.default_rng(4)
    rows = [("d", t, f, float(rng.choice([0, 0.2 + 0.02 * t, 0.6]))) for t in range(15) for f in range(1, 61)] + [("one", 1, f, 0.5) for f in range(1, 20)]
    points = spark.createDataFrame(rows, "dataset string, trace_id long, frame int, fret double")
    got = ensemble.fret_histogram_with_errors(points, resamples=60).toPandas()
    own = ensemble.histogram_counts(points, ["dataset", "trace_id"]).toPandas()
    w = dwell.bootstrap_draws(points.select("dataset", "trace_id").distinct(), 60).toPandas()
    part, shares = own[own.dataset == "d"], []
    for b in range(1, 61):
        weight = w[(w.b == b) & (w.dataset == "d")].set_index("trace_id").w
        x = (part.n * part.trace_id.map(weight).fillna(0)).groupby(part.bin).sum()
        shares.append(100 * x / x.sum())
    import pandas as pd

    sd = pd.DataFrame(shares).fillna(0).std(ddof=1)
    for r in got[got.dataset == "d"].itertuples():
        assert r.se == pytest.approx(sd[r.bin], abs=1e-9)
    assert got[got.dataset == "one"].percent.tolist() == [100]
    idl = points.withColumn("state", F.when(F.col("fret") > 0.55, 2).otherwise(1))
    lit = ensemble.fret_histogram(ensemble.live_frames(points, idl)).toPandas()
    assert lit[lit.dataset == "d"].percent.tolist() == [100]


# --- dyes ------------------------------------------------------------------------------------------------------------


def stats_of(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(f"c{i % 2}", f"f{i % 4}", i, float(rng.normal(60, 10) if i % 10 else 200 + i % 50), 0.0 if i % 7 else 1.0, float(rng.lognormal(5, 0.3)), float(rng.lognormal(2, 0.3)), float(rng.uniform(5, 30))) for i in range(n)]
    return spark.createDataFrame(rows, "condition string, dataset string, trace_id long, bg double, overlap double, t double, snr_s double, snr double")


def test_single_dyes(spark):
    stats = stats_of(spark)
    rows, want = stats.toPandas(), set()
    limits = {r.condition: r for r in dyes.background_limits(stats).collect()}
    for c, g in rows.groupby("condition"):
        n = len(g)
        t, s = np.sort(g.t)[int(0.99 * n) - 2], np.sort(g.snr_s)[int(0.99 * n) - 2]
        y = np.bincount(np.clip(np.ceil(g.bg[(g.bg > 0) & (g.bg < 300)] - 0.5).astype(int), 0, 300), minlength=301).astype(float)
        _, b, w = plain_gaussian(np.arange(301.0), y)
        assert limits[c].limit == pytest.approx(b + 4 * w, abs=0.5)
        ok = (g.snr > 10) & (g.overlap == 0) & (g.t > 0) & (g.t < t) & (g.snr_s > 0) & (g.snr_s < s) & (g.bg < limits[c].limit)
        want |= set(g.trace_id[ok])
    assert {r.trace_id for r in dyes.single_dyes(stats).collect()} == want and 50 < len(want) < 400
    assert dyes.single_dyes(stats.limit(0)).isEmpty()


def test_extreme_limits_of_large_and_tiny_conditions(spark):
    n = 25_000
    stats = spark.range(n).select(F.lit("c").alias("condition"), ((F.col("id") * 7919) % n).cast("double").alias("t"), F.col("id").cast("double").alias("snr_s")).unionByName(spark.createDataFrame([("one", 1.0, None)], "condition string, t double, snr_s double"))
    got = {r.condition: (r.t_max, r.snr_max) for r in dyes.extreme_limits(stats).collect()}
    assert got == {"c": (int(0.99 * n) - 2, int(0.99 * n) - 2), "one": (None, None)}


def test_steady_traces_and_their_dwells(spark):
    t = spark.createDataFrame([("c", "d", i, n) for i, n in enumerate([0, 1, 2, 3, 2, 2, 40, 1, 3, 2])], "condition string, dataset string, trace_id long, transitions long")
    assert {r.trace_id for r in dyes.steady(t).collect()} == {1, 2, 3, 4, 5, 7, 8, 9}
    assert dyes.steady(t.filter("trace_id = 1")).count() == 1
    runs = dwells_of(spark, {("d", 1): [(2, 3), (1, 2)], ("d", 2): [(1, 2), (2, 5)], ("d", 3): [(1, 4)]})
    assert sorted((r.trace_id, r.dwell_no) for r in dyes.less_final_dark(runs).collect()) == [(1, 1), (2, 1), (2, 2)]


def test_spreads_over_files(spark):
    rng = np.random.default_rng(6)
    rows = [("many", f"f{i % 3}", i, float(rng.random() + i % 3)) for i in range(90)] + [("single", "g", i, float(rng.random())) for i in range(80)]
    values = spark.createDataFrame(rows, "condition string, dataset string, trace_id long, x double")
    frame = values.toPandas()
    for statistic in ("mean", "median"):
        got = {r.condition: r for r in dyes.over_files(values, statistic).collect()}
        each = frame[frame.condition == "many"].groupby("dataset").x.agg(statistic)
        assert (got["many"].value, got["many"].sd, got["many"].files) == (pytest.approx(each.mean()), pytest.approx(each.std(ddof=1)), 3)
        x = frame[frame.condition == "single"].x.to_numpy()
        again = [getattr(np, statistic)(rng.choice(x, len(x))) for _ in range(2000)]
        assert got["single"].value == pytest.approx(getattr(np, statistic)(x)) and got["single"].sd == pytest.approx(np.std(again), rel=0.35)


def test_dye_report_of_made_dyes(spark):
    rng, rows, places = np.random.default_rng(7), [], []
    for file in ("a", "b"):
        for i in range(25):
            on, out = True, []
            left = int(rng.integers(150, 250))
            for f in range(300):
                if f < left and rng.random() < (0.03 if on else 0.2):
                    on = not on
                out.append(400.0 if on and f < left else 0.0)
            x = np.array(out) + rng.normal(0, 8, 300)
            rows += [(file, i, f + 1, 40.0 * f, float(v), 0.0, 0.0) for f, v in enumerate(x)]
            places.append((file, i, 50.0, 50.0))
    places += [(f, 99, 100.0, 100.0) for f in ("a", "b")]
    points = spark.createDataFrame(rows, "dataset string, trace_id long, frame int, time_ms double, donor double, acceptor double, fret double")
    got = pipelines.dye_report(points, spark.createDataFrame(places, "dataset string, trace_id long, donor_x double, donor_y double"), spark.createDataFrame([("a", "dye"), ("b", "dye")], "dataset string, condition string"), 40.0)
    report = {r.name: r for r in got["report"].collect()}
    assert report["intensity"].value == pytest.approx(400, rel=0.03) and report["intensity"].files == 2
    times = got["dwells"].first()
    assert times.mean_on == pytest.approx(0.04 / 0.03, rel=0.4) and times.mean_off == pytest.approx(0.04 / 0.2, rel=0.4)
    assert report["photons"].value == pytest.approx(400 * report["total_on"].value / 0.04, rel=0.03)
    assert got["light"].count() == 300


# --- reviews and numbers ---------------------------------------------------------------------------------------------


def test_reviews_give_one_state_in_any_order(spark, tmp_path):
    key = "dataset string, trace_id long, version int"
    one = spark.createDataFrame([("d", t, 1, ["x"], True) for t in range(6)], f"{key}, bins array<string>, adjusted boolean")
    two = spark.createDataFrame([("d", 1, 2, ["y", "x"]), ("d", 2, 2, None)], f"{key}, bins array<string>")
    three = spark.createDataFrame([("d", 2, 3, None, True), ("d", 3, 3, 1.5, False)], f"{key}, gamma double, removed boolean")
    after = spark.createDataFrame([("d", 2, 4, 0.5)], f"{key}, threshold double")
    states = []
    for k, order in enumerate(([(one, "1"), (two, "2"), (three, "3"), (after, "4")], [(after, "4"), (three, "3"), (one, "1"), (two, "2"), (one, "1"), (three, "3")])):
        for rows, name in order:
            reviews.put(rows, f"{tmp_path}/{k}", name)
        states.append(sorted(reviews.state(spark, f"{tmp_path}/{k}").collect()))
    assert states[0] == states[1] and len(states[0]) == 6
    state = {r.trace_id: r for r in states[0]}
    assert state[1].bins == ["y", "x"] and state[1].adjusted and state[3].gamma == 1.5 and state[0].version == 1
    assert (state[2].bins, state[2].adjusted, state[2].threshold, state[2].version) == (None, None, 0.5, 4)
    assert {(r.trace_id, r.bin) for r in reviews.labels(reviews.state(spark, f"{tmp_path}/0")).collect()} == {(0, "x"), (1, "x"), (1, "y"), (3, "x"), (4, "x"), (5, "x")}
    reviews.compact(spark, f"{tmp_path}/0", f"{tmp_path}/small")
    assert sorted(reviews.state(spark, f"{tmp_path}/small").collect()) == states[0]
    with pytest.raises(ValueError, match="more than once"):
        reviews.put(one.union(one), f"{tmp_path}/0", "5")


def test_updates_still_being_written_are_not_seen(spark, tmp_path):
    rows = spark.createDataFrame([("d", t, 1, 0.1) for t in range(4)], "dataset string, trace_id long, version int, crosstalk double")
    reviews.put(rows, f"{tmp_path}/r", "whole")
    part = spark.read.schema(reviews.SCHEMA).parquet(f"{tmp_path}/r").filter("trace_id < 2").withColumns({"update": F.lit("half"), "version": F.lit(2).cast("long"), "crosstalk": F.lit(9.0)})
    part.write.mode("append").parquet(f"{tmp_path}/r")
    assert {r.crosstalk for r in reviews.state(spark, f"{tmp_path}/r").collect()} == {0.1}


def test_hashed_ids_are_numbered_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BLOCK", 100)
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("dataset"), F.xxhash64("id").alias("trace_id")).unionByName(spark.createDataFrame([("9", None), ("9", 5)], "dataset string, trace_id long"))
    got = ranks.numbered(df, ["dataset"], "trace_id", "n").toPandas()
    for _, g in got.groupby("dataset"):
        g = g.sort_values("trace_id", na_position="first")
        assert g.n.tolist() == list(range(1, len(g) + 1))


@pytest.mark.parametrize("name", ["i18_rate_peaks", "i19_waiting_fits", "i16_autocovariance_fit", "i26_photobleaching", "c12_single_dyes", "j14_dye_report", "a2_old_versions", "k16_extract_movies"])
def test_queries_without_a_twin_run(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got) or name in ("i18_rate_peaks", "i16_autocovariance_fit")


def test_old_versions_give_the_points_that_were_written(spark):
    from lumatrace.sources import adapters

    got = registry.QUERIES["a2_old_versions"](spark, SF).toPandas().sort_values(["dataset", "trace_id", "frame"])
    want = adapters.vector_traces(spark, SF).toPandas().sort_values(["dataset", "trace_id", "frame"])
    counts = (want.dataset.astype(int) % 3 == 2).to_numpy()
    assert len(got) == len(want) and np.abs(got.donor.to_numpy() - want.donor.to_numpy())[~counts].max() < 1e-3
    assert (got.donor.to_numpy()[counts] == np.rint(want.donor.to_numpy()[counts])).all()
    acceptor = np.rint(want.acceptor.to_numpy()[counts]) - 0.05 * np.rint(want.donor.to_numpy()[counts])
    assert np.abs(got.acceptor.to_numpy()[counts] - acceptor).max() < 1e-3
