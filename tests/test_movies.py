"""Fields, alignment by movie and rings against hand-drawn cases and plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumatrace.operators import alignment, fields, pixels, rings

PIXELS = "movie string, frame int, channel int, y int, x int, intensity double"


def image_of(spark, arrays, x0=0):
    rows = [(m, c, y, x + (x0 if c == 2 else 0), float(v)) for (m, c), a in arrays.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "movie string, channel int, y int, x int, intensity double")


def grid(df, column, ny, nx, x0=0):
    out = np.full((ny, nx), np.nan)
    for r in df.collect():
        out[r.y, r.x - x0] = r[column]
    return out


def plain_cubic(levels, n):
    """Rows of levels drawn over n places, as image resizing by cubic convolution does it."""
    m = len(levels)
    out = []
    for u in range(1, n + 1):
        p = u * m / n + 0.5 * (1 - m / n)
        total = 0.0
        for i in range(int(np.floor(p - 2)), int(np.floor(p - 2)) + 6):
            a = abs(p - i)
            w = 1.5 * a**3 - 2.5 * a**2 + 1 if a <= 1 else -0.5 * a**3 + 2.5 * a**2 - 4 * a + 2 if a <= 2 else 0.0
            j = (i - 1) % (2 * m)
            total = total + w * levels[j if j < m else 2 * m - 1 - j]
        out.append(total)
    return np.array(out)


def test_background_is_drawn_between_blocks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((19, 27)), rng.random((12, 12))
    got = fields.background(image_of(spark, {("m", 1): a, ("n", 2): b}, 100), 6)
    for key, img, x0 in ((("m", 1), a, 0), (("n", 2), b, 100)):
        levels = np.array([[np.sort(img[6 * i : 6 * i + 6, 6 * j : 6 * j + 6].ravel())[5] for j in range(img.shape[1] // 6)] for i in range(img.shape[0] // 6)])
        want = plain_cubic(plain_cubic(levels, img.shape[0]).T, img.shape[1]).T
        assert np.abs(grid(got.filter((F.col("movie") == key[0]) & (F.col("channel") == key[1])), "background", *img.shape, x0) - want).max() < 1e-12
    flat = fields.background(image_of(spark, {("m", 1): np.full((13, 13), 7.0)}), 6, "linear")
    assert np.allclose(grid(flat, "background", 13, 13), 7)
    assert fields.background(image_of(spark, {("m", 1): a[:4, :4]}), 6).isEmpty()


def test_mask_and_quality_of_drawn_windows(spark):
    a = np.zeros((9, 9))
    a[4, 4], a[4, 5], a[3, 4] = 10, 6, 4
    a[0, 0] = 1
    image = image_of(spark, {("m", 1): a})
    peaks = spark.createDataFrame([("m", 1, 1, 4, 4)], "movie string, channel int, mol_id long, x int, y int")
    windows = pixels.integration_windows(image, peaks, 1, 3)
    mask = grid(fields.background_mask(image, windows).withColumn("v", F.lit(1.0)), "v", 9, 9)
    want = np.ones((9, 9))
    want[2:6, 3:7] = np.nan
    want[5, 3:7] = np.nan
    want[2, 6] = 1  # (3, 4) and (4, 5) reach no further
    assert (np.isnan(mask) == np.isnan(want)).all()
    r = fields.window_quality(image, peaks, 1, 3).first()
    assert (r.molecules, r.reused, r.saturated, r.efficiency, r.psf_width) == (1, 0, 1, 100, 2)  # 10 of 20, then 16 of 20
    two = spark.createDataFrame([("m", 1, 1, 4, 4), ("m", 1, 2, 5, 4)], peaks.schema)
    r = fields.window_quality(image, two, 1, 3).first()
    assert (r.molecules, r.saturated) == (2, 1) and r.reused == pytest.approx(3 / 6)
    assert fields.window_quality(image, peaks.limit(0), 1, 3).isEmpty()


def test_a_drifting_background_is_taken_off(spark):
    rows, spot = [], np.zeros((8, 8))
    spot[3:5, 3:5] = [[50, 40], [30, 20]]
    for f in range(1, 13):
        rows += [("m", f, 1, y, x, float(v + 100 + 5 * f)) for (y, x), v in np.ndenumerate(spot)]
    movies = spark.createDataFrame(rows, PIXELS)
    peaks = spark.createDataFrame([("m", 1, 1, 3, 3)], "movie string, channel int, mol_id long, x int, y int")
    windows = pixels.integration_windows(pixels.stack_average(movies), peaks, 1, 4)
    mask = fields.background_mask(pixels.stack_average(movies), windows)
    base = fields.frame_baseline(movies, mask)
    assert {r.frame: r.baseline for r in base.collect()} == {f: 100 + 5 * f for f in range(1, 13)}
    assert {r.value for r in fields.integrate_frames(movies, windows, None, base).collect()} == {140.0}
    carried = {r.frame: r.baseline for r in fields.frame_baseline(movies, mask, 10, 5).collect()}
    assert carried == {f: 100 + 5 * ((f - 1) // 5 * 5 + 1) for f in range(1, 13)}
    level = mask.select("movie", "channel").distinct().join(windows.select("movie", "channel", "y", "x"), ["movie", "channel"]).withColumn("background", F.lit(2.0))
    assert {r.value for r in fields.integrate_frames(movies, windows, level, base, {1: 0.5}).collect()} == {66.0}


def test_end_noise(spark):
    rng = np.random.default_rng(2)
    data = rng.random((15, 2, 3, 4))
    rows = [("m", f + 1, c + 1, y, x + 4 * c, float(data[f, c, y, x])) for f, c, y, x in np.ndindex(data.shape)]
    total = np.sort(data[3:14].sum(axis=1).ravel())
    assert fields.end_noise(spark.createDataFrame(rows, PIXELS)).first().noise == pytest.approx(total[: int(0.75 * len(total))].std(ddof=1))


def test_extraction_finds_made_molecules(spark):
    rng = np.random.default_rng(3)
    spots = [(10, 10, 1.0), (10, 30, 0.5), (30, 12, 0.0), (28, 30, 0.8), (28, 33, 0.8)]  # the last two stand too close
    psf = np.exp(-((np.arange(-2, 3)[:, None] ** 2 + np.arange(-2, 3) ** 2) / 2.0))
    rows = []
    for f in range(1, 21):
        for c in (1, 2):
            a = 200 + 2 * f + rng.standard_normal((40, 42)) * 2
            for y, x, e in spots:
                a[y - 2 : y + 3, x - 2 : x + 3] += psf * 500 * ((1 - e) if c == 1 else e)
            rows += [("m", f, c, y, x + 100 * (c - 1), float(v)) for (y, x), v in np.ndenumerate(a)]
    got = fields.extraction(spark.createDataFrame(rows, PIXELS), first=10, baseline=True, photons={1: 2.0, 2: 2.0})
    molecules = sorted((r.y, r.x, r.rejected) for r in got["molecules"].collect())
    assert [(y, x) for y, x, rejected in molecules if not rejected] == [(10, 10), (10, 30), (30, 12)]
    assert sum(rejected for *_, rejected in molecules) >= 1
    assert got["overlap"].first().overlapped == pytest.approx(np.mean([m[2] for m in molecules]))
    values = got["values"].groupBy("mol_id", "channel").agg(F.avg("value").alias("v"), F.stddev("value").alias("sd"), F.count("*").alias("n")).collect()
    places = {r.mol_id: (r.y, r.x) for r in got["molecules"].collect()}
    light = np.sort(psf.ravel())[::-1][:9].sum() * 1000
    for r in values:
        share = {(y, x): e for y, x, e in spots}[places[r.mol_id]]
        want = light * (share if r.channel == 2 else 1 - share)
        assert r.n == 20 and abs(r.v - want) < 0.12 * light and r.sd < 40  # neither the level nor its drift is left
    quality = got["quality"].first()
    assert quality.molecules == 3 and 60 < quality.efficiency < 100 and quality.reused == 0


def test_regions_of_any_shape(spark):
    rng = np.random.default_rng(4)
    shapes = {("m", 1): [(0, 0), (100, 0), (100, 100), (50, 20), (0, 100)], ("m", 2): [(-300.5, -7), (300, -7), (0, 410.25)], ("n", 1): [(0, 0), (10, 0), (10, 10), (0, 10)]}
    points = [("m" if k % 3 else "n", k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-60, 130, (400, 2)))]
    corners = [(m, r, i, float(x), float(y)) for (m, r), p in shapes.items() for i, (x, y) in enumerate(p)]

    def inside(x, y, p):
        odd = False
        for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True):
            if (y < y1) != (y < y2) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
        return odd

    want = {(m, k, r) for m, k, x, y in points for (n, r), p in shapes.items() if n == m and inside(x, y, p)}
    got = fields.in_regions(spark.createDataFrame(points, "movie string, id long, x double, y double"), spark.createDataFrame(corners, "movie string, region int, corner int, x double, y double"), ["movie"], 16.0)
    assert {(r.movie, r.id, r.region) for r in got.collect()} == want and len(want) > 50


def test_contrast_above_chance(spark):
    a = np.full((30, 30), 10.0)
    a[::5, ::5] = 100
    image = image_of(spark, {("m", 1): a})
    mixed = grid(fields.shuffled(image, 3), "intensity", 30, 30)
    assert sorted(mixed.ravel()) == sorted(a.ravel()) and (mixed != a).any()
    assert (mixed == grid(fields.shuffled(image.repartition(5), 3), "intensity", 30, 30)).all()
    r = fields.contrast_above_chance(image, image, 105.0).first()
    assert r.contrast == pytest.approx((200 - 20) / 20) and r.quality > 1.5


def maps_of(n):
    rng = np.random.default_rng(5)
    return {f"m{k:02}": np.array([[1 + rng.uniform(-1, 1) * 0.01, rng.uniform(-1, 1) * 0.01, k * 0.45], [rng.uniform(-1, 1) * 0.01, 1 + rng.uniform(-1, 1) * 0.01, -k * 0.35]]) for k in range(n)}


def test_every_movie_gets_its_own_map(spark):
    rng, rows = np.random.default_rng(6), {"fixed": [], "moving": []}
    maps = maps_of(20)
    for m, t in maps.items():
        grid_ = np.stack(np.meshgrid(np.arange(-120, 121, 24), np.arange(-120, 121, 24)), axis=-1).reshape(-1, 2) + rng.uniform(-4, 4, (121, 2))
        lost = rng.random(121)
        inverse = np.linalg.inv(np.vstack([t, [0, 0, 1]]))[:2]
        rows["fixed"] += [(m, i, float(x), float(y)) for i, (x, y) in enumerate(grid_) if lost[i] < 0.95]
        rows["moving"] += [(m, i, *map(float, inverse @ [x, y, 1])) for i, (x, y) in enumerate(grid_) if lost[i] > 0.05]
    make = lambda k: spark.createDataFrame(rows[k], "movie string, id int, x double, y double")
    got = {r.movie: r for r in alignment.align_groups(make("moving"), make("fixed"), 12.0, ["movie"]).collect()}
    assert set(got) == set(maps)
    for m, t in maps.items():
        r = got[m]
        assert np.abs(np.array([[r.a, r.b, r.c], [r.d, r.e, r.f]]) - t).max() < 1e-8 and r.converged and r.error < 1e-8
        inverse = np.linalg.inv(np.vstack([t, [0, 0, 1]]))
        assert (r.dx, r.dy) == pytest.approx((inverse[0, 2], inverse[1, 2]), abs=1e-8)
    assert len({r.rounds for r in got.values()}) > 1


def test_alignment_of_few_or_no_points(spark):
    schema = "movie string, id int, x double, y double"
    moving = spark.createDataFrame([("line", 1, 0.0, 0.0), ("line", 2, 10.0, 0.0), ("far", 1, 0.0, 0.0), ("alone", 1, 0.0, 0.0)], schema)
    fixed = spark.createDataFrame([("line", 1, 1.0, 2.0), ("line", 2, 11.0, 2.0), ("far", 1, 500.0, 0.0)], schema)
    got = alignment.align_groups(moving, fixed, 5.0, ["movie"]).collect()
    assert [(r.movie, r.a, r.e, r.c, r.f) for r in got] == [("line", 1, 1, 1, 2)]
    assert alignment.align_groups(moving.limit(0), fixed, 5.0, ["movie"]).isEmpty()


def test_four_made_rings_are_found(spark):
    rng, rows, want = np.random.default_rng(7), [], {}
    for q, (cx, cy) in enumerate([(288, 288), (864, 288), (288, 864), (864, 864)], start=1):
        r = 220 + 10 * q
        want[q] = (cx, cy, r)
        for k, t in enumerate(rng.uniform(0, 2 * np.pi, 60)):
            rows.append(("d", 1000 * q + k, cx + (r + rng.uniform(-2, 2)) * np.cos(t), cy + (r + rng.uniform(-2, 2)) * np.sin(t)))
        rows += [("d", 1000 * q + 500 + k, *(np.array([cx, cy]) + rng.uniform(-280, 280, 2))) for k in range(20)]
    edges = spark.createDataFrame([(d, i, float(x), float(y)) for d, i, x, y in rows], "dataset string, id long, x double, y double")
    got = {r.quadrant: r for r in rings.quadrant_rings(edges, ["dataset"], 576.0, 576.0).collect()}
    for q, (cx, cy, r) in want.items():
        assert abs(got[q].cx - cx) < 8 and abs(got[q].cy - cy) < 8 and abs(got[q].r - r) < 8 and got[q].inliers >= 55


def test_several_rings_in_one_field(spark):
    t = np.linspace(0, 2 * np.pi, 50)
    rows = [("d", k, 300 + 210 * np.cos(a), 300 + 210 * np.sin(a)) for k, a in enumerate(t)] + [("d", 100 + k, 1500 + 260 * np.cos(a), 300 + 260 * np.sin(a)) for k, a in enumerate(t[:40])]
    edges = spark.createDataFrame([(d, i, float(x), float(y)) for d, i, x, y in rows], "dataset string, id long, x double, y double")
    got = sorted(rings.fit_rings(edges, ["dataset"], circles=4, samples=400).collect(), key=lambda r: r.circle)
    assert [round(r.r) for r in got] == [210, 260] and [r.circle for r in got] == [1, 2]
    assert rings.fit_rings(edges.limit(2), ["dataset"]).isEmpty()


def test_stacked_channels_and_their_frames(spark):
    movies = spark.createDataFrame([("m", f, 1, 0, 0, float(f)) for f in range(1, 7)], PIXELS)
    got = sorted((r.channel, r.frame, r.intensity) for r in fields.split_stack(movies, [2, 0, 1]).collect())
    assert got == [(1, 1, 5), (1, 2, 6), (2, 1, 1), (2, 2, 2)]
    with pytest.raises(Exception, match="do not divide"):
        fields.split_stack(movies, [1, 2, 3, 4]).collect()
    with pytest.raises(ValueError, match="equal fields"):
        fields.split_fields(movies, [[1, 2]], 8, 7)


def test_recordings_without_times_count_frames(spark):
    movies = spark.createDataFrame([(m, f, 1, 0, 0, 1.0) for m in ("b", "a") for f in (1, 2)], PIXELS)
    starts = spark.createDataFrame([("a", 5, None), ("b", 3, None)], "movie string, started int, frame_ms double")
    got = sorted((r.frame, r.time_ms) for r in fields.one_movie(movies, starts, "x").collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_delivery_with_scale_first_fret_and_summaries(spark):
    from lumatrace.plans import pipelines
    from tests.test_library import _bright

    df = _bright(spark, 2)
    low, first = df.filter("frame = 1").agg(F.min("fret"), F.max("fret")).first()
    assert pipelines.delivery(df, {"min_snr": 8}, first_fret=low)["synced"].isEmpty()
    out = pipelines.delivery(df, {"min_snr": 8}, scale=1.0, first_fret=first + 0.01)
    assert out["split"].filter("productive").count() == 2
    assert {p.split("/")[0] for p in out if "/" in p} == {"all", "productive", "rejected"}
