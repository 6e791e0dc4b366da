"""Whole analyses: select and save, summaries, extraction, delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatrace.operators import combine, correct, dwell, dyes, ensemble, fields, pixels, project, select, states, stats
from lumatrace.operators.kernels import Model
from lumatrace.schema import CRITERIA, KEYS
from lumatrace.session import settle
from lumatrace.sources.adapters import by_trace


def select_traces(parts: list[DataFrame], criteria: dict[str, float | None] | None = None, name: str = "picked") -> tuple[DataFrame, DataFrame]:
    """Statistics, criteria, union: the picked traces as one dataset, and how many are left after each step."""
    criteria = CRITERIA if criteria is None else criteria
    picked, funnels = [], []
    for p in parts:
        s = stats.trace_stats(p)
        chosen = select.pick(s, criteria)
        picked.append(project.subset(p, chosen))
        bleached = F.coalesce(F.col("snr") > 0, F.lit(False))
        single = bleached & (F.col("overlap") == 0)
        funnels.append(s.groupBy("dataset").agg(F.count("*").alias("traces"), F.count_if(bleached).alias("donor_bleaches"), F.count_if(single).alias("single_donor"), F.count_if(single & (F.col("acclife") >= 5)).alias("have_fret"), F.count_if(select.criteria_predicate(criteria)).alias("picked")))
    log = funnels[0]
    for f in funnels[1:]:
        log = log.unionByName(f)
    return combine.combine(picked, name), log


def save(points: DataFrame, path: str, mode: str = "overwrite") -> None:
    """As Parquet, a folder for each dataset, rows of a trace together."""
    points.repartition(*KEYS).sortWithinPartitions(*KEYS, "frame").write.mode(mode).partitionBy("dataset").parquet(path)


def summary(points: DataFrame, idl: DataFrame, sampling_ms: float, contour_length: int = 50) -> dict[str, DataFrame]:
    """Contour, state histograms, transition density, occupancy and rates of a dataset, over one join."""
    both = combine.with_states(points, idl)
    c = ensemble.contour(points)
    dwells = dwell.to_dwells(both)
    return {
        "contour": c, "display": ensemble.display_contour(c, contour_length), "histogram": ensemble.fret_histogram(points), "states": dwell.state_histograms(both),
        "transitions": dwell.transition_density(both, sampling_ms), "occupancy": dwell.occupancy_by_frame(both), "rates": dwell.rates(dwells, sampling_ms), "survival": dwell.survival(dwells),
    }


def extract_traces(movies: DataFrame, threshold: float, crosstalk: float = 0.0, scale: float = 1.0, half: int = 1, n: int = 4) -> DataFrame:
    """Pixels to corrected traces: extraction, baseline, crosstalk and scale, fret."""
    raw = pixels.extract(movies, threshold, half, n)
    clean = correct.subtract_background(raw)
    return project.fret_two(correct.rescale(clean, {("donor", "acceptor"): crosstalk}, {"acceptor": scale}))


def extract_movies(movies: DataFrame, crosstalk: float = 0.0, scale: float = 1.0, frame_ms: float = 40.0, **how) -> dict[str, DataFrame]:
    """Movies to corrected traces and their metadata, in one chain: `points`, `traces`, `quality`, `overlap`.

    fields.extraction() (its parameters pass through), then the baseline after bleaching, crosstalk, scale and fret.
    traces: dataset, trace_id, ids (`movie#molecule`), donor_x, donor_y, crosstalk, scale.
    """
    got = fields.extraction(movies, **how)
    by_channel = lambda k: F.sum(F.when(F.col("channel") == k, F.col("value")))
    raw = got["values"].groupBy(F.col("movie").alias("dataset"), F.col("mol_id").alias("trace_id"), "frame").agg(by_channel(1).alias("donor"), by_channel(2).alias("acceptor"))
    raw = project.fret_two(raw.withColumn("time_ms", frame_ms * (F.col("frame") - 1)))
    points = project.fret_two(correct.rescale(correct.subtract_background(raw), {("donor", "acceptor"): crosstalk}, {"acceptor": scale}))
    kept = got["molecules"].filter("not rejected")
    traces = kept.select(F.col("movie").alias("dataset"), F.col("mol_id").alias("trace_id"), F.concat_ws("#", "movie", "mol_id").alias("ids"), F.col("x").cast("double").alias("donor_x"), F.col("y").cast("double").alias("donor_y"), F.lit(crosstalk).alias("crosstalk"), F.lit(scale).alias("scale"))
    return {"points": points, "traces": traces, "quality": got["quality"], "overlap": got["overlap"]}


def dye_report(points: DataFrame, places: DataFrame, conditions: DataFrame, sampling_ms: float, model: Model | None = None, least_snr: float = 10.0) -> dict[str, DataFrame]:
    """Dyes of each condition: `report` (condition, name, value, sd, files), `dwells` (condition, mean_on, mean_off), `light` (condition, frame, photons).

    conditions: dataset, condition. Traces in the middle of their field, single dyes by dyes.single_dyes(), states of the total
    over the condition's intensity by a two-state segmental k-means, steady ones only, the last dark dwell taken off. report
    has intensity and snr (means over files of medians), total_on and photons (of means), each with its spread over files.
    """
    model = model or Model.of([0.0, 1.0], 0.2)
    conditions = settle(conditions.select("dataset", "condition"))
    middle = settle(select.center_quadrant(places).select(*KEYS))
    columns = [*KEYS, "frame", "donor", "acceptor", "fret", *(c for c in ("acceptor2", "fret2", "stoichiometry") if c in points.columns)]
    # The points are read once and each step's rows are written: a plan that holds the steps before it several times over, with all their tasks, fills the driver.
    inside = settle(project.subset(points.select(*columns).join(conditions, "dataset"), middle))
    every = stats.trace_stats(by_trace(inside.drop("condition"), KEYS)).join(conditions, "dataset")
    chosen = settle(dyes.single_dyes(every, least_snr))
    intensity = settle(dyes.over_files(chosen.withColumn("x", F.col("t")), "median"))
    snr = settle(dyes.over_files(chosen.withColumn("x", F.col("snr_s")), "median"))
    part = settle(project.subset(inside, chosen).select("condition", *KEYS, "frame", (F.col("donor") + F.col("acceptor")).alias("total")))
    scaled = part.join(intensity.select("condition", F.col("value").alias("__level")), "condition").withColumn("x", F.try_divide("total", "__level")).drop("__level")
    idl = states.states_of(states.fit_each(scaled, model, "x"))
    runs = settle(dwell.to_dwells(idl))
    switching = settle(dyes.steady(dyes.transitions_of(runs).join(chosen.select("condition", *KEYS), KEYS)).select(*KEYS))
    kept = dyes.less_final_dark(runs.join(switching, KEYS, "left_semi"))
    shine, light = dyes.shining(part.join(switching, KEYS, "left_semi"), kept, sampling_ms)
    shine = settle(shine)
    named = [("intensity", intensity), ("snr", snr), ("total_on", dyes.over_files(shine.withColumn("x", F.col("total_on")))), ("photons", dyes.over_files(shine.withColumn("x", F.col("photons"))))]
    report = None
    for name, df in named:
        df = df.select("condition", F.lit(name).alias("name"), "value", "sd", "files")
        report = df if report is None else report.unionByName(df)
    seconds = F.col("n_frames") * sampling_ms / 1000
    times = kept.join(conditions, "dataset").groupBy("condition").agg(F.avg(F.when(F.col("state") == 2, seconds)).alias("mean_on"), F.avg(F.when(F.col("state") == 1, seconds)).alias("mean_off"))
    return {"report": report, "dwells": times, "light": light}


def delivery(points: DataFrame, criteria: dict[str, float | None], model: Model | None = None, threshold: float = 0.3, state: int = 2, least: int = 3, total: int = 50, sampling_ms: float = 40.0, scale: float | None = None, first_fret: float | None = None) -> dict[str, DataFrame]:
    """Pick, synchronise on the first fret, assign states, part productive from rejected events, and report both.

    scale: a factor for the acceptor, fret anew, before anything else. first_fret: traces that begin at it or above are not
    picked (0.2 is usual where ligands arrive during the recording). `all`, `productive` and `rejected` have summary()'s tables under
    names with a slash: `all/contour`, `productive/transitions`, ...
    """
    model = model or Model.of([0.0, 0.4, 0.7], 0.1)
    if scale is not None:
        points = project.fret_two(correct.rescale(points, {}, {"acceptor": scale}))
    limits = criteria if first_fret is None else {**criteria, "max_first_fret": first_fret}
    picked = project.subset(points, select.pick(stats.trace_stats(points), limits))
    synced = ensemble.simple_post_sync(picked, threshold, total=total)
    idl = states.states_of(states.fit_each(synced, model))
    dwells = dwell.to_dwells(idl)
    split = select.productive(dwells, state, least)
    good = idl.join(split.filter("productive").select(*KEYS), KEYS, "left_semi")
    parts = {"all": idl, "productive": good, "rejected": idl.join(split.filter("not productive").select(*KEYS), KEYS, "left_semi")}
    summaries = {f"{part}/{name}": df for part, own in parts.items() for name, df in summary(synced.join(own.select(*KEYS).distinct(), KEYS, "left_semi"), own, sampling_ms, total).items()}
    return summaries | {"synced": synced, "states": idl, "split": split, "occupancy": dwell.occupancy_by_frame(good, total), "contour": ensemble.contour(synced), "rates": dwell.rates(dwells, sampling_ms)}


def dye_diagnostics(points: DataFrame, places: DataFrame, sampling_ms: float, model: Model | None = None) -> DataFrame:
    """By dataset: on and off times, time on, photons before bleaching, of traces in the field's middle that pass a basic filter."""
    model = model or Model.of([0.0, 1.0], 0.2)
    middle = select.center_quadrant(places)
    inside = project.subset(points, middle)
    good = select.pick(stats.trace_stats(inside), {"min_snr": 1, "eq_overlap": 0})
    part = project.subset(inside, good)
    total = F.col("donor") + F.col("acceptor")
    level = part.filter("frame <= 10").groupBy("dataset").agg(F.avg(total).alias("level"))
    scaled = part.join(level, "dataset").withColumn("x", F.try_divide(total, F.col("level"))).drop("level")
    idl = states.states_of(states.fit_each(scaled, model, "x"))
    on = dwell.blinking(dwell.to_dwells(idl), len(model.mu), sampling_ms)
    photons = scaled.join(idl, [*KEYS, "frame"]).filter(F.col("state") == len(model.mu)).groupBy(*KEYS).agg(F.sum(total).alias("p")).groupBy("dataset").agg(F.avg("p").alias("photons"))
    return on.join(photons, "dataset")
