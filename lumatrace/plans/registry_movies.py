"""Registered queries of fields, alignment by movie and rings, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatrace.operators import alignment, fields, pixels, rings, select
from lumatrace.plans.registry import IMG, register, rounded
from lumatrace.plans.sql import EV, PIX, POS, q
from lumatrace.session import settle
from lumatrace.sources import adapters as A

# The movies of the test tables have fields of 4 x 8 pixels: blocks of 2, surroundings of 3 x 3, windows of 4.
SIZE, HALF, N, APART, N_NOISE = 2, 1, 4, 1.5, 0.7


def _movies(s: SparkSession, d: str) -> DataFrame:
    return A.vector_pixels(s, d)


def _axis(name: str, n: str, at: str, block: str) -> str:
    inside = "(((i - 1) % (2 * m)) + 2 * m) % (2 * m)"
    return f"""{name}a AS (SELECT movie, channel, {n} // {SIZE} AS m, {n} AS n, unnest(range(0, {n})) AS {at} FROM fs),
{name}b AS (SELECT *, ({at} + 1) * m / n + 0.5 * (1 - m / n) AS p, unnest(range(0, 6)) AS t FROM {name}a),
{name}c AS (SELECT *, CAST(floor(p - 2) AS INTEGER) + t AS i FROM {name}b),
{name}d AS (SELECT *, abs(p - i) AS a, CASE WHEN {inside} < m THEN {inside} ELSE 2 * m - 1 - {inside} END AS {block} FROM {name}c),
{name} AS (SELECT movie, channel, {at}, {block}, CASE WHEN a <= 1 THEN 1.5 * a ** 3 - 2.5 * a ** 2 + 1 WHEN a <= 2 THEN -0.5 * a ** 3 + 2.5 * a ** 2 - 4 * a + 2 ELSE 0 END AS w FROM {name}d)"""


TOP = (
    IMG + f""", fs AS (SELECT movie, channel, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS nx, max(y) - min(y) + 1 AS ny FROM img GROUP BY ALL),
blk AS (SELECT movie, channel, (y - y0) // {SIZE} AS "by", (x - x0) // {SIZE} AS bx, v, row_number() OVER (PARTITION BY movie, channel, (y - y0) // {SIZE}, (x - x0) // {SIZE} ORDER BY v, y, x) AS k FROM img JOIN fs USING (movie, channel)),
lev AS (SELECT movie, channel, "by", bx, v AS level FROM blk WHERE k = 1), {_axis("tx", "nx", "fx", "bx")}, {_axis("ty", "ny", "fy", '"by"')},
bgd AS (SELECT movie, channel, fy + y0 AS y, fx + x0 AS x, sum(tx.w * ty.w * level) AS background FROM tx JOIN ty USING (movie, channel) JOIN lev USING (movie, channel, bx, "by") JOIN fs USING (movie, channel) GROUP BY ALL),
top AS (SELECT movie, channel, y, x, v - background AS v, background FROM img JOIN bgd USING (movie, channel, y, x)),
tot AS (SELECT movie, y - y0 AS y, x - x0 AS x, sum(v) AS v FROM top JOIN fs USING (movie, channel) GROUP BY ALL)"""
)

NOISE = """ef AS (SELECT movie, max(frame) AS last FROM px GROUP BY movie),
es AS (SELECT movie, frame, y - y0 AS y, x - x0 AS x, sum(intensity) AS v FROM px JOIN ef USING (movie) JOIN fs USING (movie, channel) WHERE frame >= greatest(1, last - 11) AND frame < last GROUP BY ALL),
er AS (SELECT *, row_number() OVER (PARTITION BY movie ORDER BY v, frame, y, x) AS k, count(*) OVER (PARTITION BY movie) AS n FROM es),
noise AS (SELECT movie, stddev_samp(v) AS noise FROM er WHERE k <= floor(n * 0.75) GROUP BY movie)"""

MOL = TOP + ", " + NOISE + f""",
nt AS (SELECT *, lag(v) OVER r AS l, lead(v) OVER r AS e, lag(v) OVER c AS u, lead(v) OVER c AS w FROM tot WINDOW r AS (PARTITION BY movie, y ORDER BY x), c AS (PARTITION BY movie, x ORDER BY y)),
mk AS (SELECT movie, x, y, row_number() OVER (PARTITION BY movie ORDER BY y, x) AS mol_id FROM nt JOIN noise USING (movie) WHERE v > {N_NOISE} * noise AND coalesce(v > l, true) AND coalesce(v > u, true) AND coalesce(v >= e, true) AND coalesce(v >= w, true)),
mh AS (SELECT movie, mol_id, t.x, t.y, v - min(v) OVER (PARTITION BY movie, mol_id) AS w FROM mk JOIN tot t USING (movie) WHERE abs(t.x - mk.x) <= {HALF} AND abs(t.y - mk.y) <= {HALF}),
mc AS (SELECT movie, mol_id, sum(x * w) / nullif(sum(w), 0) AS cx, sum(y * w) / nullif(sum(w), 0) AS cy FROM mh GROUP BY ALL),
mm AS (SELECT movie, mol_id, x, y, cx, cy FROM mk JOIN mc USING (movie, mol_id)),
mol AS (SELECT *, EXISTS (SELECT 1 FROM mm o WHERE o.movie = mm.movie AND o.mol_id <> mm.mol_id AND sqrt((o.cx - mm.cx) ** 2 + (o.cy - mm.cy) ** 2) <= {APART}) AS rejected FROM mm),
pe AS (SELECT movie, channel, mol_id, rejected, x + x0 AS x, y + y0 AS y FROM mol JOIN fs USING (movie)),
hd AS (SELECT p.movie, p.channel, mol_id, rejected, t.x, t.y, t.v, background, row_number() OVER (PARTITION BY p.movie, p.channel, mol_id ORDER BY t.v DESC, t.x, t.y) AS k FROM pe p JOIN top t ON t.movie = p.movie AND t.channel = p.channel AND abs(t.x - p.x) <= {HALF} AND abs(t.y - p.y) <= {HALF}),
msk AS (SELECT movie, channel, y, x FROM top t WHERE NOT EXISTS (SELECT 1 FROM hd WHERE k <= {N} AND hd.movie = t.movie AND hd.channel = t.channel AND abs(hd.x - t.x) <= 1 AND abs(hd.y - t.y) <= 1))"""


def _top(s: SparkSession, d: str) -> DataFrame:
    return fields.top_image(_movies(s, d), 10, SIZE)


def _found(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The image and its molecules, each made once."""
    image = settle(_top(s, d))
    limits = fields.end_noise(_movies(s, d)).select("movie", (N_NOISE * F.col("noise")).alias("threshold"))
    return image, settle(fields.find_molecules(image, limits, HALF, 0, APART))


def _molecules(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d)[1]


def _quality(s: SparkSession, d: str) -> DataFrame:
    image, molecules = _found(s, d)
    return fields.window_quality(image, fields.in_channels(molecules.filter("not rejected"), image), HALF, N)


def _mask_of(image: DataFrame, molecules: DataFrame) -> DataFrame:
    return settle(fields.background_mask(image, pixels.integration_windows(image, fields.in_channels(molecules, image), HALF, N)))


def _mask(s: SparkSession, d: str) -> DataFrame:
    return _mask_of(*_found(s, d))


register("k3_background", q(TOP, "SELECT movie, channel, y, x, round(background, 4) AS background FROM bgd"))(lambda s, d: rounded(fields.background(pixels.stack_average(_movies(s, d)), SIZE), 4))
register("k2_top_image", q(TOP, "SELECT movie, channel, y, x, round(v, 4) AS intensity, round(background, 4) AS background FROM top"))(lambda s, d: rounded(_top(s, d), 4))
register("k4_end_noise", q(TOP + ", " + NOISE, "SELECT movie, round(noise, 6) AS noise FROM noise"))(lambda s, d: fields.end_noise(_movies(s, d)))
register("k5_molecules", q(MOL, "SELECT movie, mol_id, x, y, round(cx, 4) AS cx, round(cy, 4) AS cy, rejected FROM mol"))(lambda s, d: rounded(_molecules(s, d), 4))
register("k7_overlap_fraction", q(MOL, "SELECT movie, count(*) AS picked, round(avg(CAST(rejected AS INTEGER)), 6) AS overlapped FROM mol GROUP BY movie"))(lambda s, d: fields.overlap_fraction(_molecules(s, d)))
register("k13_background_mask", q(MOL, "SELECT movie, channel, y, x FROM msk"))(_mask)
register("k13_window_quality", "WITH " + MOL + f""", g AS (SELECT * FROM hd WHERE NOT rejected), nm AS (SELECT movie, channel, count(DISTINCT mol_id) AS molecules FROM g GROUP BY ALL),
sh AS (SELECT movie, channel, count(*) FILTER (c > 1) AS shared FROM (SELECT movie, channel, x, y, count(*) AS c FROM g WHERE k <= {N} GROUP BY ALL) GROUP BY ALL),
tp AS (SELECT movie, channel, max(v) AS top FROM top GROUP BY ALL), fu AS (SELECT movie, channel, count(*) FILTER (v = top) AS "full" FROM g JOIN tp USING (movie, channel) WHERE k = 1 GROUP BY ALL),
rt AS (SELECT movie, max(molecules) AS molecules, max(shared / molecules / {N}) AS reused, max("full" / molecules) AS saturated FROM nm JOIN sh USING (movie, channel) JOIN fu USING (movie, channel) GROUP BY movie),
li0 AS (SELECT movie, mol_id, k, sum(v) AS v FROM g GROUP BY ALL), li1 AS (SELECT *, v - min(v) OVER (PARTITION BY movie, mol_id) AS u FROM li0),
li2 AS (SELECT *, sum(u) OVER (PARTITION BY movie, mol_id ORDER BY k) / nullif(sum(u) OVER (PARTITION BY movie, mol_id), 0) AS f FROM li1),
ea AS (SELECT movie, mol_id, max(f) FILTER (k = {N}) AS held, count(*) FILTER (f < 0.7) + 1 AS width FROM li2 GROUP BY ALL)
SELECT movie, molecules, round(max(reused), 6) AS reused, round(max(saturated), 6) AS saturated, round(100 * avg(held), 6) AS efficiency, round(avg(width), 6) AS psf_width FROM rt JOIN ea USING (movie) GROUP BY movie, molecules""")(_quality)

BASE = """sm AS (SELECT *, row_number() OVER (PARTITION BY movie, channel ORDER BY x, y) AS k FROM msk),
bs AS (SELECT movie, channel, frame, avg(intensity) AS baseline FROM px JOIN sm USING (movie, channel, y, x) WHERE (k - 1) % 10 = 0 GROUP BY ALL)"""
register("k14_frame_baseline", q(MOL + ", " + BASE, "SELECT movie, channel, frame, round(baseline, 4) AS baseline FROM bs"))(lambda s, d: rounded(fields.frame_baseline(_movies(s, d), _mask(s, d)), 4))
register("k14_baseline_every_tenth_frame", q(MOL + ", " + BASE, "SELECT p.movie, p.channel, p.frame, round(baseline, 4) AS baseline FROM (SELECT DISTINCT movie, channel, frame FROM px) p JOIN bs ON bs.movie = p.movie AND bs.channel = p.channel AND bs.frame = (p.frame - 1) // 10 * 10 + 1"))(
    lambda s, d: rounded(fields.frame_baseline(_movies(s, d), _mask(s, d), 10, 10), 4)
)


def _values(s: SparkSession, d: str) -> DataFrame:
    movies, (image, molecules) = _movies(s, d), _found(s, d)
    windows = pixels.integration_windows(image, fields.in_channels(molecules.filter("not rejected"), image), HALF, N)
    return fields.integrate_frames(movies, windows, image.select("movie", "channel", "y", "x", "background"), fields.frame_baseline(movies, _mask_of(image, molecules)), {1: 2.0, 2: 0.5})


register("k14_integrate_frames", "WITH " + MOL + ", " + BASE + f""", su AS (SELECT p.movie, p.channel, mol_id, p.frame, sum(intensity - coalesce(baseline, 0) - background) AS v FROM px p JOIN hd ON hd.movie = p.movie AND hd.channel = p.channel AND hd.x = p.x AND hd.y = p.y AND k <= {N} AND NOT rejected
LEFT JOIN bs ON bs.movie = p.movie AND bs.channel = p.channel AND bs.frame = p.frame GROUP BY ALL) SELECT movie, mol_id, frame, channel, round(v * CASE WHEN channel = 1 THEN 2.0 ELSE 0.5 END, 3) AS value FROM su""")(lambda s, d: rounded(_values(s, d), 3))


def _half_image(s: SparkSession, d: str, channel: int) -> DataFrame:
    return fields.in_field(pixels.stack_average(_movies(s, d))).filter(F.col("channel") == channel).select("movie", F.lit(1).alias("channel"), F.col("fy").alias("y"), F.col("fx").alias("x"), "intensity")


SHUFFLE = ", ".join(
    f"pl{c}{k} AS (SELECT movie, y, x, row_number() OVER (PARTITION BY movie ORDER BY md5('place{2 * k + c - 1}:1:' || y || ':' || x)) AS r FROM h{c}), vl{c}{k} AS (SELECT movie, v, row_number() OVER (PARTITION BY movie ORDER BY md5('value{2 * k + c - 1}:1:' || y || ':' || x)) AS r FROM h{c}), s{c}{k} AS (SELECT movie, y, x, v FROM pl{c}{k} JOIN vl{c}{k} USING (movie, r))"
    for c in (1, 2) for k in (0, 1)
)
_CON = "(avg(a.v + b.v) FILTER (a.v + b.v > 2000) - avg(a.v + b.v) FILTER (a.v + b.v < 2000)) / nullif(avg(a.v + b.v) FILTER (a.v + b.v < 2000), 0)"
register("k10_contrast_above_chance", "WITH " + IMG + f""", h1 AS (SELECT movie, y, x, v FROM img WHERE channel = 1), h2 AS (SELECT movie, y, x - 4 AS x, v FROM img WHERE channel = 2), {SHUFFLE},
own AS (SELECT movie, {_CON} AS contrast FROM h1 a JOIN h2 b USING (movie, y, x) GROUP BY movie),
ch AS (SELECT movie, avg(c) AS by_chance FROM ({' UNION ALL '.join(f"SELECT movie, {_CON} AS c FROM s1{k} a JOIN s2{k} b USING (movie, y, x) GROUP BY movie" for k in (0, 1))}) GROUP BY movie)
SELECT movie, round(contrast, 6) AS contrast, round(by_chance, 6) AS by_chance, round(contrast / nullif(by_chance, 0), 6) AS quality FROM own JOIN ch USING (movie)""")(lambda s, d: fields.contrast_above_chance(_half_image(s, d, 1), _half_image(s, d, 2), 2000.0))


def _shifted(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Eight places for each trace about the field's middle, a movie for each day; the moving ones turned and shifted, by day."""
    k, f = F.col("trace_id"), F.col("frame")
    places = A.event_traces(s, d).filter("frame <= 8").select((k % 5).cast("string").alias("movie"), (k * 10 + f).alias("id"), ((k * 37 + f * 211) % 1152 - 576).cast("double").alias("x"), ((k * 91 + f * f * 57) % 1152 - 576).cast("double").alias("y"))
    m = F.col("movie").cast("int")
    moving = places.select("movie", "id", ((1 + 0.001 * m) * F.col("x") - 0.002 * F.col("y") + m - 2).alias("x"), (0.002 * F.col("x") + (1 + 0.001 * m) * F.col("y") + 1.5 - m).alias("y"))
    return moving, places


register("k9_align_movies", q(EV, """SELECT CAST(m AS VARCHAR) AS movie, count(*) AS pairs, true AS converged, round(m - 2, 4) + 0.0 AS dx, round(1.5 - m, 4) + 0.0 AS dy,
round(degrees(atan2(-0.002, 1 + 0.001 * m)), 4) AS theta, round(sqrt((1 + 0.001 * m) ** 2 + 0.002 ** 2), 4) AS scale FROM (SELECT trace_id % 5 AS m FROM pts WHERE frame <= 8) GROUP BY m"""))(
    lambda s, d: rounded(alignment.align_groups(*_shifted(s, d), 12.0, ["movie"]).select("movie", "pairs", "converged", "dx", "dy", "theta", "scale"), 4)
)


def _regions(s: SparkSession, d: str) -> DataFrame:
    """A star of ten corners around each trace's place, in the recording of that trace's day."""
    p = A.positioned(A.event_traces(s, d)).select((F.col("trace_id") % 5).cast("string").alias("movie"), F.col("trace_id").alias("region"), "donor_x", "donor_y")
    c = p.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(9))))
    r = F.when(F.col("corner") % 2 == 0, 300.0).otherwise(110.0)
    return c.select("movie", "region", "corner", (F.col("donor_x") + r * F.cos(F.col("corner") * 0.6283185307179586)).alias("x"), (F.col("donor_y") + r * F.sin(F.col("corner") * 0.6283185307179586)).alias("y"))


register("k18_in_regions", "WITH " + POS + """, p AS (SELECT CAST(trace_id % 5 AS VARCHAR) AS movie, trace_id AS id, donor_x AS x, donor_y AS y FROM pos), c AS (SELECT movie, id AS region, x, y, unnest(range(0, 10)) AS corner FROM p),
v AS (SELECT movie, region, corner, x + CASE WHEN corner % 2 = 0 THEN 300.0 ELSE 110.0 END * cos(corner * 0.6283185307179586) AS x, y + CASE WHEN corner % 2 = 0 THEN 300.0 ELSE 110.0 END * sin(corner * 0.6283185307179586) AS y FROM c),
e AS (SELECT a.movie, a.region, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON b.movie = a.movie AND b.region = a.region AND b.corner = (a.corner + 1) % 10)
SELECT p.movie, id, region FROM p JOIN e ON e.movie = p.movie WHERE y1 <> y2 AND (y < y1) <> (y < y2) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1""")(
    lambda s, d: fields.in_regions(A.positioned(A.event_traces(s, d)).select((F.col("trace_id") % 5).cast("string").alias("movie"), F.col("trace_id").alias("id"), F.col("donor_x").alias("x"), F.col("donor_y").alias("y")), _regions(s, d), ["movie"])
)


# --- rings -----------------------------------------------------------------------------------------------------------


def _edges(s: SparkSession, d: str) -> DataFrame:
    return select.spot_edges(A.positioned(A.event_traces(s, d)), 16.0)


def _rings_sql(least: int, low: float, high: float) -> str:
    draw = lambda salt: f"CAST(concat('0x', substr(md5(dataset || ':' || quadrant || ':' || s || ':{salt}'), 1, 8)) AS BIGINT)"
    return "WITH " + POS + f""", cl AS (SELECT DISTINCT CAST(floor(donor_x / 16) AS BIGINT) AS cx, CAST(floor(donor_y / 16) AS BIGINT) AS cy FROM pos),
ed AS (SELECT 'events' AS dataset, cx * 100000 + cy AS id, (cx + 0.5) * 16 AS x, (cy + 0.5) * 16 AS y FROM cl c WHERE (SELECT count(*) FROM cl o WHERE abs(o.cx - c.cx) + abs(o.cy - c.cy) = 1) < 4),
q0 AS (SELECT *, 1 + CAST(x > 576 AS INTEGER) + 2 * CAST(y > 576 AS INTEGER) AS quadrant FROM ed),
nu AS (SELECT *, row_number() OVER (PARTITION BY dataset, quadrant ORDER BY id) - 1 AS no FROM q0),
sz AS (SELECT dataset, quadrant, count(*) AS n FROM nu GROUP BY ALL HAVING count(*) >= {max(3, least)}),
d0 AS (SELECT *, unnest(range(1, 1001)) AS s FROM sz), d1 AS (SELECT *, {draw(1)} % n AS i1, {draw(2)} % (n - 1) AS j2, {draw(3)} % (n - 2) AS j3 FROM d0),
d2 AS (SELECT *, j2 + CAST(j2 >= i1 AS INTEGER) AS i2 FROM d1), d3 AS (SELECT *, j3 + CAST(j3 >= least(i1, i2) AS INTEGER) AS k3 FROM d2), d4 AS (SELECT *, k3 + CAST(k3 >= greatest(i1, i2) AS INTEGER) AS i3 FROM d3),
p AS (SELECT d4.dataset, d4.quadrant, s, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, c.x AS x3, c.y AS y3 FROM d4 JOIN nu a ON a.quadrant = d4.quadrant AND a.no = i1 JOIN nu b ON b.quadrant = d4.quadrant AND b.no = i2 JOIN nu c ON c.quadrant = d4.quadrant AND c.no = i3),
e1 AS (SELECT *, x2 - x1 AS a1, y2 - y1 AS b1, x3 - x2 AS a2, y3 - y2 AS b2, 0.5 * (x2 ** 2 - x1 ** 2 + y2 ** 2 - y1 ** 2) AS r1, 0.5 * (x3 ** 2 - x2 ** 2 + y3 ** 2 - y2 ** 2) AS r2 FROM p),
e2 AS (SELECT *, (r1 * b2 - r2 * b1) / (a1 * b2 - b1 * a2) AS cx, (a1 * r2 - a2 * r1) / (a1 * b2 - b1 * a2) AS cy FROM e1 WHERE abs(a1 * b2 - b1 * a2) >= 1e-10),
e3 AS (SELECT dataset, quadrant, s, cx, cy, sqrt((x1 - cx) ** 2 + (y1 - cy) ** 2) AS r FROM e2),
e4 AS (SELECT e.dataset, e.quadrant, s, cx, cy, r, count(*) AS inliers FROM e3 e JOIN nu ON nu.quadrant = e.quadrant WHERE r > {low} AND r < {high} AND abs(sqrt((x - cx) ** 2 + (y - cy) ** 2) - r) <= 12 GROUP BY ALL HAVING count(*) >= {least}),
e5 AS (SELECT *, row_number() OVER (PARTITION BY dataset, quadrant ORDER BY inliers DESC, s) AS k FROM e4)
SELECT k.dataset, k.quadrant, 1 AS circle, coalesce(round(cx, 4), 0) AS cx, coalesce(round(cy, 4), 0) AS cy, coalesce(round(r, 4), 0) AS r, coalesce(inliers, 0) AS inliers FROM (SELECT DISTINCT dataset, quadrant FROM q0) k LEFT JOIN e5 ON e5.quadrant = k.quadrant AND e5.k = 1"""


# The second takes any circle through three points of the sparse test tables.
register("c18_quadrant_rings", _rings_sql(10, 205.0, 280.0))(lambda s, d: rounded(rings.quadrant_rings(_edges(s, d), ["dataset"], 576.0, 576.0), 4))
register("c18_small_rings", _rings_sql(3, 60.0, 280.0))(lambda s, d: rounded(rings.quadrant_rings(_edges(s, d), ["dataset"], 576.0, 576.0, least=3, radius=(60.0, 280.0)), 4))
register("c18_near_expected_rings", "WITH " + POS + """, p AS (SELECT trace_id AS id, donor_x AS x, donor_y AS y FROM pos), c AS (SELECT a.s AS sx, b.s AS sy FROM (VALUES (-1), (1)) a(s), (VALUES (-1), (1)) b(s))
SELECT id, x, y FROM p WHERE EXISTS (SELECT 1 FROM c WHERE sqrt((x - 576 - sx * 160 / (13 / 60.0) / 2) ** 2 + (y - 576 - sy * 160 / (13 / 60.0) / 2) ** 2) <= 140 / (13 / 60.0) / 2)
AND NOT EXISTS (SELECT 1 FROM c WHERE sqrt((x - 576 - sx * 170 / (13 / 60.0) / 2) ** 2 + (y - 576 - sy * 170 / (13 / 60.0) / 2) ** 2) <= 70 / (13 / 60.0) / 2)""")(
    lambda s, d: rings.near_expected_rings(A.positioned(A.event_traces(s, d)).select(F.col("trace_id").alias("id"), F.col("donor_x").alias("x"), F.col("donor_y").alias("y")), 1152.0, 1152.0)
)
register("k1_geometry", "WITH " + PIX + """, t AS (SELECT movie, frame, [2, 0, 1, 3][y // 4 * 2 + x // 4 + 1] AS channel, y % 4 AS y, x % 4 AS x, intensity FROM px)
SELECT movie, channel, y, x, round(avg(intensity), 4) AS v FROM t WHERE channel > 0 GROUP BY ALL""")(
    lambda s, d: rounded(fields.split_fields(_movies(s, d), [[2, 0], [1, 3]], 8, 8).groupBy("movie", "channel", "y", "x").agg(F.avg("intensity").alias("v")), 4)
)
register("k19_beam_profile", "WITH " + PIX + """, i AS (SELECT movie, y, x, sum(intensity) AS v FROM px WHERE frame <= 100 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY movie ORDER BY v, y, x) AS k, count(*) OVER (PARTITION BY movie) AS n FROM i),
l AS (SELECT movie, y, x, v - avg(v) FILTER (k <= greatest(1, n // 20)) OVER (PARTITION BY movie) AS v FROM r), u AS (SELECT movie, y, x, v / sum(v) OVER (PARTITION BY movie) AS v FROM l),
c AS (SELECT movie, sum(x * v) AS cx, sum(y * v) AS cy FROM u GROUP BY movie), f AS (SELECT u.*, cx, cy FROM u JOIN c USING (movie)),
g AS (SELECT * FROM f WHERE x + 1 BETWEEN floor(cx + 1 - 2) AND floor(cx + 1 + 2) AND y + 1 BETWEEN floor(cy + 1 - 1.5) AND floor(cy + 1 + 1.5))
SELECT movie, round(max(cx), 6) AS cx, round(max(cy), 6) AS cy, round(sum(v), 6) AS inside, round(stddev_pop(v) / avg(v), 6) AS uniformity FROM g GROUP BY movie""")(lambda s, d: fields.beam_profile(_movies(s, d), 4, 3))
register("a21_one_movie", "WITH " + PIX + """, n AS (SELECT movie, max(frame) AS n, 1000 - CAST(movie AS INTEGER) AS started FROM px GROUP BY movie), b AS (SELECT movie, sum(n) OVER (ORDER BY started) - n AS before, 20.0 + first_value(CAST(movie AS INTEGER)) OVER (ORDER BY started) AS step FROM n)
SELECT CAST(frame + before AS INTEGER) AS frame, round((frame + before - 1) * step, 3) AS time_ms, round(sum(intensity), 2) AS light FROM px JOIN b USING (movie) GROUP BY ALL""")(
    lambda s, d: rounded(fields.one_movie(_movies(s, d), _movies(s, d).select("movie").distinct().select("movie", (1000 - F.col("movie").cast("int")).alias("started"), (20.0 + F.col("movie").cast("int")).alias("frame_ms")), "all").groupBy("frame", "time_ms").agg(F.sum("intensity").alias("light")), 2)
)
