"""Registered queries of fits by group, dyes, errors of histograms, reviews and trace files with metadata, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatrace.operators import dwell, dyes, ensemble, reviews, stats
from lumatrace.plans import pipelines
from lumatrace.plans.registry import EXPORTED, HB, RATES, _bl, _dw, register, rounded
from lumatrace.plans.sql import DW, EMB, EV, POS, STATS, q
from lumatrace.schema import KEYS
from lumatrace.session import settle, work_dir
from lumatrace.sources import adapters as A
from lumatrace.sources import files, legacy, metadata

# --- fits by group ---------------------------------------------------------------------------------------------------

register("i18_log_rate_histogram", q(RATES, """SELECT dataset, src, dst, bin, round(-3 + 0.3 * (bin - 1), 6) AS center, round(n / sum(n) OVER g, 6) AS share, sum(n) OVER g AS n_traces
FROM (SELECT dataset, src, dst, CAST(least(27, greatest(1, ceil(round((round(ln(k), 9) + 3) / 0.3 + 0.5, 6)))) AS INTEGER) AS bin, count(*) AS n FROM rt WHERE n >= 4 GROUP BY ALL) WINDOW g AS (PARTITION BY dataset, src, dst)"""))(
    lambda s, d: dwell.log_rate_histogram(_dw(s, d), 40.0)
)
register("i18_rate_peaks")(lambda s, d: dwell.rate_peaks(dwell.log_rate_histogram(_dw(s, d), 40.0)))
register("i19_waiting_curve", "WITH " + DW + """, nx AS (SELECT *, lead(state) OVER (PARTITION BY trace_id ORDER BY dwell_no) AS dst FROM dw), g AS (SELECT DISTINCT dataset, state AS src, dst FROM nx WHERE dst IS NOT NULL)
SELECT g.dataset, src, g.dst, CAST(frame AS INTEGER) AS frame, count(*) FILTER (n_frames > frame) AS "left" FROM g JOIN nx ON nx.dataset = g.dataset AND nx.state = src AND nx.dst = g.dst, range(0, 100) t(frame) GROUP BY ALL""")(lambda s, d: dwell.waiting_curve(_dw(s, d)))
register("i19_waiting_fits")(lambda s, d: dwell.waiting_fits(dwell.waiting_curve(_dw(s, d)), 40.0))
register("i16_autocovariance_fit")(lambda s, d: _covariance_fit(s, d))


def _covariance_fit(s: SparkSession, d: str) -> DataFrame:
    found = dwell.autocovariance_fit(dwell.autocovariance(_dw(s, d), 3))
    return s.createDataFrame([(k, *map(float, v)) for k, v in found.items()], "dataset string, y0 double, a double, k double")


register("i26_photobleaching")(lambda s, d: ensemble.photobleaching(stats.trace_stats(_bl(s, d)))["summary"])
register("i27_time_to_state_curve", "WITH " + DW + """, f AS (SELECT trace_id, min(start_frame) AS start_frame FROM dw WHERE state = 2 AND n_frames * 0.04 >= 0.08 GROUP BY ALL)
SELECT 'events' AS dataset, CAST(frame AS INTEGER) AS frame, round(frame * 0.04, 6) AS seconds, round((SELECT count(*) FROM f WHERE least(start_frame - 1, 3000) <= frame) / (SELECT count(DISTINCT trace_id) FROM pts), 6) AS reached FROM range(0, 3001) t(frame)""")(
    lambda s, d: dwell.time_to_state_curve(_dw(s, d), A.event_traces(s, d).groupBy("dataset").agg(F.countDistinct("trace_id").alias("n_traces")), 2, 0.08)
)

# --- errors of histograms --------------------------------------------------------------------------------------------

register("j3_histogram_with_errors", "WITH " + EV + f""", own AS (SELECT dataset, trace_id, {HB} AS bin, count(*) AS n FROM pts WHERE frame <= 50 AND fret <> 0 GROUP BY ALL),
u AS (SELECT *, CAST('0x' || substr(md5(dataset || '#' || trace_id || '#' || b), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM (SELECT DISTINCT dataset, trace_id FROM pts), range(1, 101) t(b)),
w AS (SELECT *, CAST(u >= 0.36787944117144233 AS INTEGER) + CAST(u >= 0.7357588823428847 AS INTEGER) + CAST(u >= 0.9196986029286058 AS INTEGER) + CAST(u >= 0.9810118431238462 AS INTEGER) + CAST(u >= 0.9963401531726563 AS INTEGER)
  + CAST(u >= 0.9994058151824183 AS INTEGER) + CAST(u >= 0.9999167588507119 AS INTEGER) AS w FROM u),
x AS (SELECT dataset, b, bin, sum(w * n) AS x FROM w JOIN own USING (dataset, trace_id) GROUP BY ALL), p AS (SELECT dataset, b, bin, 100.0 * x / sum(x) OVER (PARTITION BY dataset, b) AS p FROM x),
full_ AS (SELECT k.dataset, k.bin, t.b, coalesce(p, 0) AS p FROM (SELECT DISTINCT dataset, bin FROM own) k CROSS JOIN range(1, 101) t(b) LEFT JOIN p ON p.dataset = k.dataset AND p.bin = k.bin AND p.b = t.b),
h AS (SELECT dataset, bin, 100.0 * n / sum(n) OVER (PARTITION BY dataset) AS percent FROM (SELECT dataset, bin, sum(n) AS n FROM own GROUP BY dataset, bin))
SELECT dataset, bin, round(percent, 6) AS percent, round(se, 6) AS se FROM h JOIN (SELECT dataset, bin, stddev_samp(p) AS se FROM full_ GROUP BY ALL) USING (dataset, bin)""")(lambda s, d: ensemble.fret_histogram_with_errors(A.event_traces(s, d)))
register("j3_live_histogram", "WITH " + EV + f""", i AS (SELECT *, CASE WHEN fret >= 0.3 THEN 2 ELSE 1 END AS state FROM pts)
SELECT dataset, bin, round(100.0 * n / sum(n) OVER (PARTITION BY dataset), 6) AS percent FROM (SELECT dataset, {HB} AS bin, count(*) AS n FROM i WHERE frame <= 50 AND state = 2 GROUP BY ALL)""")(
    lambda s, d: ensemble.fret_histogram(ensemble.live_frames(A.event_traces(s, d), A.event_traces(s, d).select(*KEYS, "frame", F.when(F.col("fret") >= 0.3, 2).otherwise(1).alias("state"))))
)

# --- dyes ------------------------------------------------------------------------------------------------------------


def _conditions(s: SparkSession, d: str) -> DataFrame:
    """Statistics of bleached traces; two conditions by trace."""
    return stats.trace_stats(_bl(s, d)).withColumn("condition", F.concat(F.lit("c"), F.col("trace_id") % 2))


register("c12_background_histogram", q(STATS, "SELECT 'c' || (trace_id % 2) AS condition, CAST(ceil(round(round(bg, 9) + 0.5, 6)) AS INTEGER) AS bin, count(*) AS n FROM stats WHERE bg > 0 AND bg < 300 GROUP BY ALL"))(lambda s, d: dyes.background_histogram(_conditions(s, d)))
register("c12_extreme_limits", q(STATS, """SELECT condition, round(max(t) FILTER (kt = floor(0.99 * n) - 1), 6) AS t_max, round(max(snr_s) FILTER (ks = floor(0.99 * n) - 1), 6) AS snr_max
FROM (SELECT 'c' || (trace_id % 2) AS condition, coalesce(t, 0) AS t, coalesce(snr_s, 0) AS snr_s, row_number() OVER (PARTITION BY trace_id % 2 ORDER BY coalesce(t, 0)) AS kt, row_number() OVER (PARTITION BY trace_id % 2 ORDER BY coalesce(snr_s, 0)) AS ks, count(*) OVER (PARTITION BY trace_id % 2) AS n FROM stats) GROUP BY condition"""))(
    lambda s, d: dyes.extreme_limits(_conditions(s, d))
)
register("c12_single_dyes")(lambda s, d: dyes.single_dyes(_conditions(s, d), 1.0).select("condition", *KEYS, "t", "snr", "bg"))
register("j14_dye_report")(lambda s, d: _dye_report(s, d))


def _dye_report(s: SparkSession, d: str) -> DataFrame:
    """The lineitem traces as two files of one condition."""
    points = _bl(s, d).withColumn("dataset", F.concat(F.lit("file"), F.col("trace_id") % 2))
    traces = settle(points.select(*KEYS).distinct())
    places = traces.withColumns({"donor_x": (F.col("trace_id") * 37 % 100).cast("double"), "donor_y": (F.col("trace_id") * 91 % 100).cast("double")})
    conditions = traces.select("dataset").distinct().withColumn("condition", F.lit("dye"))
    return pipelines.dye_report(points, places, conditions, 40.0, least_snr=1.0)["report"]


# --- reviews ---------------------------------------------------------------------------------------------------------

REVIEW = POS + """, up AS (SELECT trace_id, 1 AS version, 'a' AS name, ['first', 'all'] AS bins, true AS adjusted, 0.1 AS crosstalk, NULL AS gamma, false AS removed FROM pos
UNION ALL SELECT trace_id, 2, 'b', CASE WHEN trace_id % 4 = 0 THEN ['second'] END, NULL, NULL, 1.0 + trace_id % 3, trace_id % 5 = 0 FROM pos WHERE trace_id % 2 = 0
UNION ALL SELECT trace_id, 2, 'c', NULL, false, 0.2, NULL, false FROM pos WHERE trace_id % 3 = 0)"""


def _reviewed(s: SparkSession, d: str) -> DataFrame:
    """Three overlapping updates, two of them written twice and one left unfinished."""
    path = f"{work_dir(s)}/reviews"
    p = A.positioned(A.event_traces(s, d)).select(*KEYS)
    n = F.col("trace_id")
    a = p.select(*KEYS, F.lit(1).alias("version"), F.array(F.lit("first"), F.lit("all")).alias("bins"), F.lit(True).alias("adjusted"), F.lit(0.1).alias("crosstalk"))
    b = p.filter(n % 2 == 0).select(*KEYS, F.lit(2).alias("version"), F.when(n % 4 == 0, F.array(F.lit("second"))).alias("bins"), (1.0 + n % 3).alias("gamma"), (n % 5 == 0).alias("removed"))
    c = p.filter(n % 3 == 0).select(*KEYS, F.lit(2).alias("version"), F.lit(False).alias("adjusted"), F.lit(0.2).alias("crosstalk"))
    for rows, name in ((c, "c"), (a, "a"), (b, "b"), (a, "a"), (c, "c")):
        reviews.put(rows, path, name)
    half = s.read.schema(reviews.SCHEMA).parquet(path).filter("update = 'a'").limit(1).withColumns({"update": F.lit("torn"), "version": F.lit(9).cast("long"), "gamma": F.lit(-1.0), "update_rows": F.lit(2).cast("long")})
    half.write.mode("append").parquet(path)
    return reviews.state(s, path)


register("a17_review_state", "WITH " + REVIEW + """, cut AS (SELECT trace_id, max(version || name) FILTER (removed) AS cut FROM up GROUP BY trace_id), live AS (SELECT up.* FROM up JOIN cut USING (trace_id) WHERE cut IS NULL OR version || name > cut)
SELECT 'events' AS dataset, trace_id, array_to_string(arg_max(bins, version || name) FILTER (bins IS NOT NULL), ',') AS bins, arg_max(adjusted, version || name) FILTER (adjusted IS NOT NULL) AS adjusted,
CAST(arg_max(crosstalk, version || name) FILTER (crosstalk IS NOT NULL) AS DOUBLE) AS crosstalk, CAST(arg_max(gamma, version || name) FILTER (gamma IS NOT NULL) AS DOUBLE) AS gamma, CAST(max(version) AS BIGINT) AS version FROM live GROUP BY trace_id""")(
    lambda s, d: _reviewed(s, d).select(*KEYS, F.array_join("bins", ",").alias("bins"), "adjusted", "crosstalk", "gamma", "version")
)

# --- trace files -----------------------------------------------------------------------------------------------------


def _metadata_of(points: DataFrame) -> DataFrame:
    """An id, a place and a 2 x 2 matrix for each trace, a list of numbers for each file."""
    traces, n = points.select(*KEYS).distinct(), F.col("trace_id")
    row = lambda field, kind, dims, numbers, text: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("type"), F.array(*dims).alias("dims"), numbers.cast("array<double>").alias("numbers"), text.cast("string").alias("text"))
    one, none = F.lit(1), F.lit(None)
    of_trace = F.array(
        row("ids", "char", (one, F.length(n.cast("string")) + 1), none, F.concat(F.lit("t"), n)), row("donor_x", "double", (one, one), F.array(n * 0.5), none),
        row("fit.crosstalk", "single", (F.lit(2), F.lit(2)), F.array(F.lit(0.0), (n % 4) * 0.25, F.lit(0.5), F.lit(1.0)), none),
    )
    rows = traces.select("dataset", F.lit("trace").alias("scope"), "trace_id", F.explode(of_trace).alias("v")).select("dataset", "scope", "trace_id", "v.*")
    own = points.select("dataset").distinct().select("dataset", F.lit("file").alias("scope"), F.lit(None).cast("long").alias("trace_id"), F.lit("wavelengths").alias("field"), F.lit("uint16").alias("type"), F.array(F.lit(1), F.lit(2)).alias("dims"), F.array(F.lit(532.0), F.lit(640.0)).alias("numbers"), F.lit(None).cast("string").alias("text"))
    return rows.unionByName(own)


def _with_metadata(s: SparkSession, d: str) -> DataFrame:
    points = A.vector_traces(s, d)
    path = f"{work_dir(s)}/traces"
    files.save_files(metadata.export_traces(points, _metadata_of(points)), path, ".traces")
    got = metadata.read_metadata(s, path).withColumn("dataset", F.regexp_extract("dataset", r"([^/]+)\.traces$", 1))
    got = files.whole(got, points, "trace_id")
    got = got.filter("scope = 'trace'").unionByName(got.filter("scope = 'file'").distinct())  # each file of a dataset holds its values
    return got.select("dataset", "scope", F.coalesce("trace_id", F.lit(0)).alias("trace_id"), "field", "type", F.array_join(F.transform("dims", lambda x: x.cast("string")), "x").alias("dims"), F.array_join(F.transform("numbers", lambda x: F.format_string("%.2f", x)), ",").alias("numbers"), "text")


register("a5_file_metadata", q(EXPORTED, """SELECT dataset, 'trace' AS scope, k AS trace_id, 'ids' AS field, 'char' AS type, '1x' || (length(CAST(trace_id AS VARCHAR)) + 1) AS dims, NULL AS numbers, 't' || trace_id AS text FROM ex WHERE frame = 1
UNION ALL SELECT dataset, 'trace', k, 'donor_x', 'double', '1x1', printf('%.2f', trace_id * 0.5), NULL FROM ex WHERE frame = 1
UNION ALL SELECT dataset, 'trace', k, 'fit.crosstalk', 'single', '2x2', '0.00,' || printf('%.2f', (trace_id % 4) * 0.25) || ',0.50,1.00', NULL FROM ex WHERE frame = 1
UNION ALL SELECT DISTINCT dataset, 'file', 0, 'wavelengths', 'uint16', '1x2', '532.00,640.00', NULL FROM ex"""))(_with_metadata)


def _old_files(s: SparkSession, d: str) -> DataFrame:
    """The vectors' traces as files of three old versions by label, read back from one folder."""
    import numpy as np
    import pandas as pd

    def write(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["trace_id", "frame"])
        n, m, part = f["trace_id"].nunique(), f["frame"].nunique(), int(f["dataset"].iloc[0].split("-")[0]) % 3
        time, c = f["time_ms"].to_numpy()[:m], {k: f[k].to_numpy(float).reshape(n, m) for k in ("donor", "acceptor", "fret")}
        ids = [f"v{i}" for i in f["trace_id"].unique()]
        data = legacy.encode_counts(time, np.rint(c["donor"]), np.rint(c["acceptor"]), ids) if part == 2 else legacy.encode_paged(time, c, ids, 3 + part)
        return pd.DataFrame({"dataset": [f["dataset"].iloc[0]], "content": [data]})

    path = f"{work_dir(s)}/old"
    points = A.vector_traces(s, d)
    files.save_files(files.filed(points, 5000).groupBy("dataset").applyInPandas(write, "dataset string, content binary"), path, ".traces")
    got = legacy.read_recordings(s, path).withColumn("dataset", F.regexp_extract("dataset", r"([^/]+)\.traces$", 1))
    return files.whole(got, points, "trace_id").select("dataset", "trace_id", "frame", "time_ms", "donor", F.round("acceptor", 3).alias("acceptor"), F.round("fret", 4).alias("fret"))


# The 16-bit traces don't bleach (no frames after their lifetime, which is their length), so no baseline is taken off them.
register("a2_old_versions")(lambda s, d: rounded(_old_files(s, d), 3))
register("k16_extract_movies")(lambda s, d: pipelines.extract_movies(A.vector_pixels(s, d), 0.05, 1.1, first=10, size=2, n_noise=0.7, half=1, n=4, edge=0, apart=1.5, baseline=True)["points"])
