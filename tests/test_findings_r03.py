"""Cases of the third round's findings, by their numbers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_f1_a_round_of_a_joint_fit_is_one_job(spark):
    from lumatrace.operators import states
    from lumatrace.operators.kernels import Model

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([("d", t, f + 1, float(x)) for t in range(6) for f, x in enumerate(rng.normal([0.2, 0.7], 0.1, (20, 2)).ravel())], "dataset string, trace_id long, frame int, fret double")
    for fit in (states.baum_welch, states.fit_jointly):
        jobs = {}
        for r in (1, 13):
            group = f"f1-{fit.__name__}-{r}"
            spark.sparkContext.setJobGroup(group, group)
            with pytest.warns(UserWarning):
                fit(df, Model.of([0.1, 0.8], 0.2), rounds=r, tolerance=-1.0)
            jobs[r] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert jobs[13] - jobs[1] == 12


def _against_sql(spark, folder, name, **tables):
    """The query and its SQL twin over tables of a folder of their own."""
    import duckdb

    from lumatrace.plans import registry
    from tests.test_oracles import _rows

    con = duckdb.connect()
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    ours, theirs = registry.QUERIES[name](spark, str(folder)).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _rows(ours) == _rows(theirs)


@pytest.mark.parametrize("name", ["a1_trace_files", "a3_file_catalog", "a5_file_metadata"])
def test_f2_f3_f4_a_dataset_of_several_files_is_read_as_one(spark, tmp_path, name):
    vectors = spark.range(5003).select(F.col("id").alias("vec_id"), (F.col("id") == 7).cast("int").alias("label"), F.array(F.col("id") / 10007, F.col("id") / 20011).cast("array<float>").alias("embedding"))
    _against_sql(spark, tmp_path, name, embeddings=vectors)


def test_f5_segments_count_on_over_the_files_of_a_dataset(spark, tmp_path):
    events = spark.range(5003).select("id", F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("user_id"), F.lit(1.0).alias("value"), F.concat(F.lit("n"), F.col("id") % 9 + 1).alias("props"))
    _against_sql(spark, tmp_path, "a6_dwell_files", events=events.drop("id"))


def test_f6_points_on_a_polygons_edges_are_outside(spark):
    from lumatrace.operators import pixels

    points = spark.createDataFrame([(1, 50.0, 300.0), (2, 250.0, 300.0), (3, 60.0, 900.0), (4, 60.0, 300.0), (5, 50.0, 100.0), (6, 40.0, 300.0)], "id long, x double, y double")
    assert [r.id for r in pixels.in_polygon(points, [(50.0, 100.0), (850.0, 900.0), (50.0, 900.0)]).collect()] == [4]


def test_f7_a_mean_halfway_between_two_roundings_is_rounded_as_sql_does(spark):
    import duckdb

    from lumatrace.plans import registry

    con = duckdb.connect()
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    ours = registry.QUERIES["j5_mean_fret_by_frame"](spark, "/root/testdata/sf0.01").toPandas()
    theirs = con.execute(registry.ORACLES["j5_mean_fret_by_frame"]).df()
    assert dict(zip(ours["frame"], ours["mean_fret"], strict=True)) == dict(zip(theirs["frame"], theirs["mean_fret"], strict=True))


def test_f8_f17_copies_are_compared_once(spark):
    from lumatrace.operators import fields, pixels

    spots = spark.range(40).select(F.lit("m").alias("movie"), "id", (F.col("id") % 2 * 50.0).alias("x"), F.lit(0.0).alias("y"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    near = pixels.closest(spots, spots, 30.0, ["movie"])
    assert "Aggregate" in plan(near) and near.count() == 40 and near.filter("d > 0 or tx <> x").count() == 0
    square = F.explode(F.array(*[F.struct(F.lit(c).alias("corner"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for c, (dx, dy) in enumerate([(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)])]))
    corners = spots.select("movie", F.col("id").alias("region"), "x", "y", square.alias("s")).select("movie", "region", "s.corner", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    found = fields.in_regions(spots, corners, ["movie"])
    assert "collect_list" in plan(found)  # shapes are brought together before points meet them
    assert {(r.id, r.region) for r in found.collect()} == {(i, j) for i in range(40) for j in range(40) if i % 2 == j % 2}


def test_f9_a_tasks_rows_do_not_grow_with_the_table(spark):
    from lumatrace.sources import adapters

    rows = spark.range(5000).select((F.col("id") % 500).alias("k"))
    parts = adapters.by_trace(rows, "k", 100)
    assert parts.rdd.getNumPartitions() == 50
    assert parts.select("k", F.spark_partition_id().alias("p")).distinct().count() == 500


def test_f15_f20_statistics_are_computed_once(spark):
    from lumatrace.operators import dyes, ensemble, select

    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f

    columns = ["t", "snr", "snr_s", "bg", "overlap", "donorlife", "acclife"]
    made_of = spark.range(100).select(F.lit("d").alias("dataset"), F.col("id").alias("trace_id"), F.lit("c").alias("condition"), *[(F.lit(0.0) if c == "overlap" else F.col("id") + 1.0).alias(c) for c in columns])
    events = spark.range(100).select(F.lit("d").alias("dataset"), F.col("id").alias("trace_id"), (F.col("id") % 3).alias("events"))
    for f in (dyes.extreme_limits, lambda s: dyes.single_dyes(s, 1.0), lambda s: select.within_sigma(s, 2.0), select.representative, lambda s: select.dye_filter(s, events, 100.0), lambda s: ensemble.photobleaching(s)["summary"]):
        stats = made_of.mapInPandas(count, made_of.schema)
        before = made.value
        f(stats).collect()
        assert made.value - before == 100


def test_f25_a_trace_is_computed_once_and_drawn_beside_its_rows(spark):
    import hashlib

    from lumatrace.operators import dwell, dyes, ensemble

    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            made.add(len(f))
            yield f

    rows = [("d", t, "c", 1, 2 + t % 2, t % 5, 10 + t) for t in range(30)] + [("one", 7, "c", 1, 2, 3, 4), ("d", None, "c", 1, 2, 900, 1)]
    columns = "dataset string, trace_id long, condition string, frame int, state int, events int, n long"
    each = spark.createDataFrame(rows, columns)
    counted = each.mapInPandas(count, each.schema)
    points = counted.withColumn("fret", F.col("events") / 10)
    for f in (
        lambda: dwell.bootstrap_se(counted.select("dataset", "trace_id", "events", "n"), F.col("events") / F.col("n"), 50),
        lambda: dwell.bootstrap_percent(counted, 50),
        lambda: dwell.bootstrap_sums(ensemble.histogram_counts(points, ["dataset", "trace_id"]), ["bin"], ["n"], 50),
        lambda: dwell.bootstrap_draws(counted, 50),
    ):
        before, df = made.value, f()
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
        df.collect()
        assert made.value - before == len(rows)
    assert dwell.bootstrap_sums(each, [], ["n"], 50)._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert dyes.over_files(each.filter("dataset = 'd'").withColumn("x", F.col("n").cast("double"))).collect()[0].sd > 0

    limits = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    drawn = lambda d, t, b: sum(int(hashlib.md5(f"{d}#{t}#{b}".encode()).hexdigest()[:8], 16) / 2**32 >= x for x in limits)
    draws = {(r.dataset, r.trace_id, r.b): r.w for r in dwell.bootstrap_draws(each, 1000).collect()}
    want = {(d, t, b): drawn(d, t, b) for d, t, *_ in rows if t is not None for b in range(1, 1001)}
    assert draws == {k: w for k, w in want.items() if w}
    se = {r.dataset: r.se for r in dwell.bootstrap_se(each.select("dataset", "trace_id", "events", "n"), F.col("events") / F.col("n"), 1000).collect()}
    sums = [(sum(want["d", t, b] * e for _, t, _, _, _, e, _ in rows[:30]), sum(want["d", t, b] * n for _, t, _, _, _, _, n in rows[:30])) for b in range(1, 1001)]
    assert se == {"d": pytest.approx(np.std([e / n for e, n in sums], ddof=1), rel=1e-9), "one": 0.0}  # resamples that draw nothing don't count


@pytest.mark.parametrize(("name", "users"), [("u1_bootstrap_statistic", 1), ("u1_bootstrap_statistic", 9), ("i20_bootstrap", 1), ("i20_bootstrap", 9), ("j3_histogram_with_errors", 9)])
def test_f25_draws_of_few_traces_and_of_none(spark, tmp_path, name, users):
    user = F.when(F.col("id") % 11 != 0, F.col("id") % users)  # rows without a user too
    events = spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), user.alias("user_id"), (F.col("id") * 7 % 31 + 1.0).alias("value"), F.concat(F.lit("n"), F.col("id") * 5 % 43).alias("props"))
    _against_sql(spark, tmp_path, name, events=events)


def test_pipeline_the_drivers_fit_holds_its_sample_once():
    import tracemalloc

    from lumatrace.llm import quality

    rng = np.random.default_rng(3)
    weights = np.where(rng.random((1500, quality.WIDTH)) < 0.2, rng.random((1500, quality.WIDTH)), 0.0)
    plain = (weights - weights.mean(axis=0)) * (1 / (0.05 + weights.std(axis=0)))
    tracemalloc.start()
    model = quality.LatentModel(weights, 48)
    known = model.project(weights)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < weights.nbytes / 2
    assert np.array_equal(weights, plain)
    expected = plain @ model.axes
    assert np.allclose(known, expected / np.linalg.norm(expected, axis=1, keepdims=True), rtol=0, atol=1e-12)


def test_pipeline_components_that_are_stars_take_no_round(spark, monkeypatch):
    from lumatrace.llm import graph

    calls, step = [], graph._half_step
    monkeypatch.setattr(graph, "_half_step", lambda edges, small: calls.append(small) or step(edges, small))

    def of(edges):
        calls.clear()
        return {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}

    assert of([(1, 5), (9, 1), (2, 7), (7, 2), (3, 3)]) == {1: 1, 5: 1, 9: 1, 2: 2, 7: 2} and not calls
    assert of([(2, 9), (3, 9), (3, 4)]) == dict.fromkeys([2, 3, 4, 9], 2) and calls
    assert set(of([(i, i + 1) for i in range(40)]).values()) == {0}
