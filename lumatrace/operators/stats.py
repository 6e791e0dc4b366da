"""Per-trace statistics: one row for each trace, from one chain of windows over (dataset, trace_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.functions import seq
from lumatrace.schema import CONSTANTS, KEYS


def trace_stats(points: DataFrame) -> DataFrame:
    """Statistics of every trace. All are 0 where no bleach step is found before the last frame.

    points: keys, frame, donor, acceptor, fret [, acceptor2, fret2, stoichiometry]. Every window shares the partitioning
    of the final aggregation, so the whole of it needs one exchange.
    """
    t, c = seq.whole(), CONSTANTS
    three = "fret2" in points.columns
    extra = [x for x in ("acceptor2", "fret2", "stoichiometry") if x in points.columns]
    total = F.col("donor") + F.col("acceptor") + (F.coalesce("acceptor2", F.lit(0.0)) if "acceptor2" in extra else F.lit(0.0))
    df = points.select(*KEYS, "frame", "donor", "acceptor", "fret", *extra, total.alias("total"))
    df = seq.with_gradient(df, "total").withColumn("len", F.max("frame").over(t))
    df = df.withColumn("mean_g", F.avg("__grad").over(t)).withColumn("sd_g", seq.std1_over(F.col("__grad"), t))
    clean = F.when(~(F.abs("__grad") > F.col("mean_g") + 6 * F.col("sd_g")), F.col("__grad"))
    df = df.withColumn("sd_clean", seq.std1_over(clean, t))
    lt = F.max(F.when(F.col("__grad") <= F.col("mean_g") - c.n_std * F.col("sd_clean"), F.col("frame"))).over(t)
    df = df.withColumn("lt", lt).withColumn("lt", F.when(F.col("lt") < F.col("len"), F.col("lt")))

    # Drops that the signal does not come back from; the last one is the bleaching itself.
    df = df.withColumn("drop", F.col("__grad") <= F.col("mean_g") - c.overlap_std * F.col("sd_g"))
    event = F.col("drop") & ~F.lag("drop").over(seq.by_frame()) & (F.col("frame") > 5) & (F.col("frame") <= F.col("lt"))
    before = F.min(F.when(F.col("frame") >= 2, F.col("__med"))).over(seq.rows(Window.unboundedPreceding, -1))
    # What follows a frame, as a running maximum from the trace's end: a frame that only grows is summed up once.
    later = Window.partitionBy(*KEYS).orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.max(F.when(F.col("frame") <= F.col("lt"), F.col("__med"))).over(later)
    df = df.withColumn("event", F.coalesce(event, F.lit(False))).withColumn("apart", F.coalesce(after < before, F.lit(False)))
    df = df.withColumn("last_event", F.max(F.when(F.col("event"), F.col("frame"))).over(t))
    df = df.withColumn("early", F.col("event") & F.col("apart") & (F.col("frame") < F.col("last_event")))

    tail = F.when(F.col("frame").between(F.col("lt") + 5, F.col("lt") + 5 + c.background_frames), F.col("total"))
    df = df.withColumn("sd_bg", seq.std1_over(tail, t))
    inside = F.when(F.col("lt") < 3, F.col("frame") <= F.col("lt") - 1).otherwise(F.col("frame") <= F.col("lt") - 2)
    dark = (F.col("lt") >= 3) & F.coalesce(F.col("total") <= c.blink_std * F.col("sd_bg"), F.lit(False))
    df = df.withColumn("inside", F.coalesce(inside, F.lit(False))).withColumn("dark", F.col("inside") & dark)
    w = seq.by_frame()
    side = lambda f: F.coalesce(~f("dark").over(w) | ~f("inside").over(w), F.lit(True))
    df = df.withColumn("crossing", F.col("dark") & ~F.coalesce(F.lag("dark").over(w), F.lit(False)))
    df = df.withColumn("alive", F.col("inside") & ~F.col("dark") & side(F.lag) & side(F.lead))

    # Over the donor-alive frames alone, closed up.
    own = Window.partitionBy(*KEYS, "alive").orderBy("frame")
    df = df.withColumn("at", F.row_number().over(own)).withColumn("grad_d", seq.gradient("donor", own)).withColumn("grad_a", seq.gradient("acceptor", own))

    upto = F.coalesce(F.col("frame") <= F.col("lt"), F.lit(False))
    level = (F.col("stoichiometry") > 0.1) & (F.col("stoichiometry") < 0.9) if "stoichiometry" in extra else F.col("fret") >= c.min_fret
    df = df.withColumn("high", upto & F.coalesce(level, F.lit(False)))
    df = seq.long_runs(df, "high", "lit").withColumn("above", upto & (F.col("fret") > c.fret_event))
    df = df.withColumn("rise", F.col("above") & ~F.coalesce(F.lag("above").over(w), F.lit(False)))
    if three:
        df = seq.long_runs(df.withColumn("high2", upto & (F.col("fret2") >= c.min_fret)), "high2", "lit2")

    on = lambda flag, x: F.when(F.col(flag), F.col(x))
    corr = lambda a, b: F.try_divide(F.covar_samp(on("alive", a), on("alive", b)), F.stddev_samp(on("alive", a)) * F.stddev_samp(on("alive", b)))
    far = F.when(F.col("frame") >= F.col("lt") + 5, 1)
    out = df.groupBy(*KEYS).agg(
        F.max("lt").alias("lt"), F.max("len").alias("len"), F.max("sd_bg").alias("sd_bg"),
        F.max(F.when(F.col("early"), F.col("frame"))).alias("last_early"),
        (F.coalesce(seq.std1(F.when(far == 1, F.col("donor"))), F.lit(0.0)) + F.coalesce(seq.std1(F.when(far == 1, F.col("acceptor"))), F.lit(0.0))).alias("bg"),
        F.count_if("crossing").alias("ncross"), F.count_if(F.col("inside") & ~F.col("dark")).alias("donorlife"), F.count_if("alive").alias("n_alive"),
        (F.sum(F.when(F.col("alive") & (F.col("at") <= 10), F.col("donor") + F.col("acceptor"))) / 10).alias("t"),
        corr("donor", "acceptor").alias("corr"), corr("grad_d", "grad_a").alias("corrd"),
        seq.std1(F.when(F.col("alive"), F.col("donor") + F.col("acceptor"))).alias("noise"),
        F.count_if("lit").alias("acclife"), F.avg(on("lit", "fret")).alias("avg_fret"), seq.std1(F.when(F.col("lit"), F.col("donor") + F.col("acceptor"))).alias("lit_noise"),
        F.count_if("rise").alias("fret_events"), F.max(F.when(F.col("frame") == 1, F.col("fret"))).alias("first_fret"), F.max(F.when(F.col("frame") <= F.col("lt"), F.col("fret"))).alias("max_fret"),
        *([F.count_if("lit2").alias("fret2_lifetime"), F.avg(on("lit2", "fret2")).alias("avg_fret2"), F.max(F.when(F.col("frame") <= F.col("lt"), F.col("fret2"))).alias("max_fret2")] if three else []),
    )
    ok, enough, room, long = F.col("lt").isNotNull(), F.col("n_alive") >= 2, F.col("lt") + 10 < F.col("len"), F.col("lt") > 1
    zero = lambda x, *when: F.when(_all(ok, *when), x)
    t_ = F.when(enough, F.col("t"))
    stats = {
        "lifetime": zero(F.greatest(F.lit(2), F.col("lt"))), "overlap": zero(F.col("last_early").isNotNull().cast("int")), "safe_region": zero(F.coalesce(F.col("last_early") + 2, F.lit(2))),
        "bg": zero(F.col("bg"), room), "ncross": zero(F.col("ncross")), "donorlife": zero(F.col("donorlife")), "t": zero(t_, enough),
        "snr": zero(F.try_divide(t_, F.col("sd_bg")), enough, room), "snr_s": zero(F.try_divide(t_, F.col("noise")), enough), "nnr": zero(F.try_divide(F.col("noise"), F.col("sd_bg")), enough),
        "corr": zero(F.col("corr"), enough), "corrd": zero(F.col("corrd"), enough), "acclife": zero(F.col("acclife"), long), "avg_fret": zero(F.col("avg_fret"), long, F.col("acclife") > 1),
        "snrs_fret": zero(F.try_divide(F.coalesce(t_, F.lit(0.0)), F.col("lit_noise")), long, F.col("acclife") > 1), "fret_events": zero(F.col("fret_events"), long), "first_fret": zero(F.col("first_fret")), "max_fret": zero(F.col("max_fret")),
    }
    if three:
        stats |= {"fret2_lifetime": zero(F.col("fret2_lifetime"), long), "avg_fret2": zero(F.col("avg_fret2"), long, F.col("fret2_lifetime") > 1), "max_fret2": zero(F.col("max_fret2"), long)}
    undefined = {"corr": enough, "corrd": enough, "snr": enough & room, "snr_s": enough, "nnr": enough, "snrs_fret": long & (F.col("acclife") > 1)}
    final = []
    for name, value in stats.items():
        # What is defined but cannot be divided stays null, so that criteria reject it; what does not apply is 0.
        asked = F.coalesce(ok & undefined[name], F.lit(False)) if name in undefined else F.lit(False)
        final.append(F.when(asked, value).otherwise(F.coalesce(value.cast("double"), F.lit(0.0))).cast("double").alias(name))
    return out.select(*KEYS, *final)


def _all(first: F.Column, *rest: F.Column) -> F.Column:
    for r in rest:
        first = first & r
    return first


def stat_distribution(stats: DataFrame, name: str, bins: int = 40) -> DataFrame:
    """Share in percent of the traces in each of `bins` equal bins between the least and greatest value: (bin, center, percent, mean)."""
    x = stats.select(F.col(name).alias("x")).filter("x is not null")
    if name in ("corr", "corrd"):
        low, step, bins = F.lit(-1.0), F.lit(0.1), 21
        limits = x.agg(F.avg("x").alias("mean"), F.count("*").alias("n")).withColumns({"low": low, "step": step})
    else:
        x = x.withColumn("x", F.least("x", F.lit(1000.0))) if name == "snr" else x
        limits = x.agg(F.avg("x").alias("mean"), F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).select("mean", "n", ((F.col("b") - F.col("a")) / bins).alias("step"), (F.col("a") + (F.col("b") - F.col("a")) / bins / 2).alias("low"))
    at = F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil(F.round(F.coalesce(F.try_divide(F.col("x") - F.col("low"), F.col("step")), F.lit(0.0)) + 0.5, 6)))).cast("int")
    rows = x.crossJoin(F.broadcast(limits)).withColumn("bin", at)
    return rows.groupBy("bin").agg((100 * F.count("*") / F.first("n")).alias("percent"), (F.first("low") + (F.col("bin") - 1) * F.first("step")).alias("center"), F.first("mean").alias("mean"))
