"""SQL of the table views, shared by the SQL twins of the queries."""

EV = """ev AS (SELECT 'events' AS dataset, user_id AS trace_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS frame,
    value AS donor, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS acceptor FROM events),
pts AS (SELECT *, 40.0 * (frame - 1) AS time_ms, donor + acceptor AS total, round(coalesce(acceptor / nullif(donor + acceptor, 0), 0), 6) AS fret,
    count(*) OVER (PARTITION BY trace_id) AS len FROM ev)"""

BL = """li AS (SELECT 'lineitem' AS dataset, l_suppkey AS trace_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS frame,
    l_quantity AS donor, l_extendedprice / l_quantity / 1000 AS acceptor, count(*) OVER (PARTITION BY l_suppkey) AS len FROM lineitem),
bl0 AS (SELECT dataset, trace_id, frame, 40.0 * (frame - 1) AS time_ms, len,
    donor + CASE WHEN frame <= floor(0.6 * len) AND frame % 97 <> 50 THEN 500.0 + CASE WHEN trace_id % 3 = 0 AND frame <= floor(0.2 * len) THEN 400.0 ELSE 0 END ELSE 0 END AS donor,
    acceptor + CASE WHEN frame <= floor(0.6 * len) AND frame % 97 <> 50 THEN 300.0 * (1 + floor(frame / 40) % 2) ELSE 0 END AS acceptor FROM li),
bl AS (SELECT *, round(coalesce(acceptor / nullif(donor + acceptor, 0), 0), 6) AS fret FROM bl0),
blt AS (SELECT *, donor + acceptor AS total FROM bl)"""

IDL = EV + """,
idl AS (SELECT *, CASE WHEN frame > coalesce(max(CASE WHEN fret <> 0 THEN frame END) OVER (PARTITION BY trace_id), 0) THEN 0
    ELSE 1 + CAST(fret >= 0.3 AS INTEGER) + CAST(fret >= 0.6 AS INTEGER) END AS state FROM pts)"""

DW = IDL + """,
chg AS (SELECT *, CASE WHEN lag(state) OVER w IS NOT DISTINCT FROM state AND frame > 1 THEN 0 ELSE 1 END AS changed FROM idl WINDOW w AS (PARTITION BY trace_id ORDER BY frame)),
runs AS (SELECT *, sum(changed) OVER (PARTITION BY trace_id ORDER BY frame) AS run FROM chg),
dw0 AS (SELECT dataset, trace_id, run, state, min(frame) AS start_frame, count(*) AS n_frames, avg(fret) AS mean_fret FROM runs GROUP BY dataset, trace_id, run, state HAVING state > 0),
dw AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY run) AS dwell_no FROM dw0)"""

EMB = """em AS (SELECT CAST(label AS VARCHAR) AS dataset, vec_id AS trace_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS frame FROM embeddings),
emb AS (SELECT dataset, trace_id, CAST(frame AS INTEGER) AS frame, 40.0 * (frame - 1) AS time_ms, round(0.5 + CAST(x AS DOUBLE), 6) AS fret FROM em),
embt AS (SELECT *, 100 * (1 - fret) AS donor, 100 * fret AS acceptor FROM emb)"""

POS = """pos AS (SELECT DISTINCT 'events' AS dataset, user_id AS trace_id, CAST((user_id * 37) % 1152 AS DOUBLE) AS donor_x, CAST((user_id * 91) % 1152 AS DOUBLE) AS donor_y,
    '/day' || (user_id % 5) || '/movie.rawtraces#' || user_id AS ids FROM events)"""

PIX = """px0 AS (SELECT CAST(label AS VARCHAR) AS movie, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS INTEGER) AS frame, embedding FROM embeddings),
px1 AS (SELECT movie, frame, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS cell FROM px0),
px AS (SELECT movie, frame, CASE WHEN cell % 8 < 4 THEN 1 ELSE 2 END AS channel, CAST(cell // 8 AS INTEGER) AS y, CAST(cell % 8 AS INTEGER) AS x, round(1000 * (1 + CAST(v AS DOUBLE)), 4) AS intensity FROM px1)"""

LIFE = """lm AS (SELECT *, median(total) OVER (PARTITION BY trace_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS med FROM blt),
lg AS (SELECT *, coalesce((lead(med) OVER w - lag(med) OVER w) / 2, lead(med) OVER w - med, med - lag(med) OVER w, 0) AS g FROM lm WINDOW w AS (PARTITION BY trace_id ORDER BY frame)),
ls AS (SELECT *, avg(g) OVER t AS mg, CASE WHEN count(g) OVER t = 1 THEN 0 ELSE stddev_samp(g) OVER t END AS sg FROM lg WINDOW t AS (PARTITION BY trace_id)),
lc AS (SELECT *, CASE WHEN abs(g) <= mg + 6 * sg THEN g END AS clean FROM ls),
ll AS (SELECT *, avg(clean) OVER t - 8 * CASE WHEN count(clean) OVER t = 1 THEN 0 ELSE stddev_samp(clean) OVER t END AS lim FROM lc WINDOW t AS (PARTITION BY trace_id)),
lf AS (SELECT *, CASE WHEN max(CASE WHEN g <= lim AND frame < len THEN frame END) OVER t IS NULL THEN len ELSE greatest(2, max(CASE WHEN g <= lim AND frame < len THEN frame END) OVER t) END AS lifetime FROM ll WINDOW t AS (PARTITION BY trace_id))"""

STATS = BL + """,
m1 AS (SELECT *, median(total) OVER (PARTITION BY trace_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS med FROM blt),
m2 AS (SELECT *, coalesce((lead(med) OVER w - lag(med) OVER w) / 2, lead(med) OVER w - med, med - lag(med) OVER w, 0) AS g FROM m1 WINDOW w AS (PARTITION BY trace_id ORDER BY frame)),
m3 AS (SELECT *, avg(g) OVER t AS mg, CASE WHEN count(g) OVER t = 1 THEN 0 ELSE stddev_samp(g) OVER t END AS sg FROM m2 WINDOW t AS (PARTITION BY trace_id)),
m4 AS (SELECT *, CASE WHEN NOT abs(g) > mg + 6 * sg THEN g END AS clean FROM m3),
m5 AS (SELECT *, CASE WHEN count(clean) OVER t = 1 THEN 0 ELSE stddev_samp(clean) OVER t END AS sc FROM m4 WINDOW t AS (PARTITION BY trace_id)),
m6 AS (SELECT *, max(CASE WHEN g <= mg - 8 * sc THEN frame END) OVER (PARTITION BY trace_id) AS lt0 FROM m5),
m7 AS (SELECT *, CASE WHEN lt0 < len THEN lt0 END AS lt, g <= mg - 5 * sg AS dropped FROM m6),
m8 AS (SELECT *, coalesce(dropped AND NOT lag(dropped) OVER w AND frame > 5 AND frame <= lt, false) AS event,
    coalesce(max(CASE WHEN frame <= lt THEN med END) OVER (PARTITION BY trace_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
      < min(CASE WHEN frame >= 2 THEN med END) OVER (PARTITION BY trace_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS apart FROM m7 WINDOW w AS (PARTITION BY trace_id ORDER BY frame)),
m9 AS (SELECT *, max(CASE WHEN event THEN frame END) OVER t AS last_event,
    CASE WHEN count(CASE WHEN frame BETWEEN lt + 5 AND lt + 105 THEN total END) OVER t = 1 THEN 0 ELSE stddev_samp(CASE WHEN frame BETWEEN lt + 5 AND lt + 105 THEN total END) OVER t END AS sd_bg FROM m8 WINDOW t AS (PARTITION BY trace_id)),
n1 AS (SELECT *, coalesce(CASE WHEN lt < 3 THEN frame <= lt - 1 ELSE frame <= lt - 2 END, false) AS inside FROM m9),
n2 AS (SELECT *, inside AND lt >= 3 AND coalesce(total <= 4 * sd_bg, false) AS dark, coalesce(frame <= lt, false) AND fret >= 0.08 AS high, coalesce(frame <= lt, false) AND fret > 0.14 AS above FROM n1),
n3 AS (SELECT *, dark AND NOT coalesce(lag(dark) OVER w, false) AS crossing, above AND NOT coalesce(lag(above) OVER w, false) AS rise,
    inside AND NOT dark AND coalesce(NOT lag(dark) OVER w OR NOT lag(inside) OVER w, true) AND coalesce(NOT lead(dark) OVER w OR NOT lead(inside) OVER w, true) AS alive,
    CASE WHEN lag(high) OVER w IS NOT DISTINCT FROM high AND frame > 1 THEN 0 ELSE 1 END AS hc FROM n2 WINDOW w AS (PARTITION BY trace_id ORDER BY frame)),
n4 AS (SELECT *, sum(hc) OVER (PARTITION BY trace_id ORDER BY frame) AS hrun, row_number() OVER a AS pos,
    coalesce((lead(donor) OVER a - lag(donor) OVER a) / 2, lead(donor) OVER a - donor, donor - lag(donor) OVER a, 0) AS gd,
    coalesce((lead(acceptor) OVER a - lag(acceptor) OVER a) / 2, lead(acceptor) OVER a - acceptor, acceptor - lag(acceptor) OVER a, 0) AS ga FROM n3 WINDOW a AS (PARTITION BY trace_id, alive ORDER BY frame)),
n5 AS (SELECT *, high AND count(*) OVER (PARTITION BY trace_id, hrun) > 5 AS lit FROM n4),
agg AS (SELECT dataset, trace_id, max(lt) AS lt, max(len) AS len, max(sd_bg) AS sd_bg, max(CASE WHEN event AND apart AND frame < last_event THEN frame END) AS early,
    coalesce(CASE WHEN count(CASE WHEN frame >= lt + 5 THEN donor END) = 1 THEN 0 ELSE stddev_samp(CASE WHEN frame >= lt + 5 THEN donor END) END, 0)
      + coalesce(CASE WHEN count(CASE WHEN frame >= lt + 5 THEN donor END) = 1 THEN 0 ELSE stddev_samp(CASE WHEN frame >= lt + 5 THEN acceptor END) END, 0) AS bg,
    count(*) FILTER (crossing) AS ncross, count(*) FILTER (inside AND NOT dark) AS donorlife, count(*) FILTER (alive) AS na,
    sum(total) FILTER (alive AND pos <= 10) / 10 AS t,
    covar_samp(CASE WHEN alive THEN donor END, CASE WHEN alive THEN acceptor END) / nullif(stddev_samp(donor) FILTER (alive) * stddev_samp(acceptor) FILTER (alive), 0) AS corr,
    covar_samp(CASE WHEN alive THEN gd END, CASE WHEN alive THEN ga END) / nullif(stddev_samp(gd) FILTER (alive) * stddev_samp(ga) FILTER (alive), 0) AS corrd,
    CASE WHEN count(*) FILTER (alive) = 1 THEN 0 ELSE stddev_samp(total) FILTER (alive) END AS noise,
    count(*) FILTER (lit) AS acclife, avg(fret) FILTER (lit) AS avg_fret, CASE WHEN count(*) FILTER (lit) = 1 THEN 0 ELSE stddev_samp(total) FILTER (lit) END AS lit_noise,
    count(*) FILTER (rise) AS fret_events, max(fret) FILTER (frame = 1) AS first_fret, max(fret) FILTER (frame <= lt) AS max_fret FROM n5 GROUP BY dataset, trace_id),
stats AS (SELECT dataset, trace_id,
    coalesce(CAST(greatest(2, CASE WHEN lt IS NOT NULL THEN lt END) AS DOUBLE) * CASE WHEN lt IS NOT NULL THEN 1 END, 0.0) AS lifetime,
    CASE WHEN lt IS NOT NULL AND early IS NOT NULL THEN 1.0 ELSE 0.0 END AS overlap, CASE WHEN lt IS NULL THEN 0.0 ELSE CAST(coalesce(early + 2, 2) AS DOUBLE) END AS safe_region,
    CASE WHEN lt + 10 < len THEN bg ELSE 0.0 END AS bg, CASE WHEN lt IS NULL THEN 0.0 ELSE CAST(ncross AS DOUBLE) END AS ncross, CASE WHEN lt IS NULL THEN 0.0 ELSE CAST(donorlife AS DOUBLE) END AS donorlife,
    CASE WHEN lt IS NOT NULL AND na >= 2 THEN t ELSE 0.0 END AS t, CASE WHEN na >= 2 AND lt + 10 < len THEN t / nullif(sd_bg, 0) ELSE 0.0 END AS snr,
    CASE WHEN lt IS NOT NULL AND na >= 2 THEN t / nullif(noise, 0) ELSE 0.0 END AS snr_s, CASE WHEN lt IS NOT NULL AND na >= 2 THEN noise / nullif(sd_bg, 0) ELSE 0.0 END AS nnr,
    CASE WHEN lt IS NOT NULL AND na >= 2 THEN corr ELSE 0.0 END AS corr, CASE WHEN lt IS NOT NULL AND na >= 2 THEN corrd ELSE 0.0 END AS corrd,
    CASE WHEN lt > 1 THEN CAST(acclife AS DOUBLE) ELSE 0.0 END AS acclife, CASE WHEN lt > 1 AND acclife > 1 THEN avg_fret ELSE 0.0 END AS avg_fret,
    CASE WHEN lt > 1 AND acclife > 1 THEN CASE WHEN na >= 2 THEN t ELSE 0.0 END / nullif(lit_noise, 0) ELSE 0.0 END AS snrs_fret,
    CASE WHEN lt > 1 THEN CAST(fret_events AS DOUBLE) ELSE 0.0 END AS fret_events, CASE WHEN lt IS NULL THEN 0.0 ELSE first_fret END AS first_fret, CASE WHEN lt IS NULL THEN 0.0 ELSE max_fret END AS max_fret FROM agg)"""

STAT_NAMES = "lifetime overlap safe_region bg ncross donorlife t snr snr_s nnr corr corrd acclife avg_fret snrs_fret fret_events first_fret max_fret".split()


def q(with_: str, select: str) -> str:
    return f"WITH {with_}\n{select}"
