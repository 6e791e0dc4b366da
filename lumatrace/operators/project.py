"""Projections and trace algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.functions import ranks, seq
from lumatrace.schema import KEYS


def subset(points: DataFrame, traces: DataFrame | list[int] | None = None, frames: tuple[int, int] | None = None) -> DataFrame:
    """Some traces (ids, or a table of keys) and a range of frames; ids that don't exist are passed over."""
    if isinstance(traces, list):
        points = points.filter(F.col("trace_id").isin(traces))
    elif traces is not None:
        points = points.join(traces.select(*KEYS), KEYS, "left_semi")
    return points if frames is None else points.filter(F.col("frame").between(*frames))


def truncate(points: DataFrame, frames: int) -> DataFrame:
    return points.filter(F.col("frame") <= frames)


def extend(points: DataFrame, frames: int, step_ms: float = 40.0) -> DataFrame:
    """Every trace to `frames` frames, each channel's last value repeated."""
    channels = [c for c in points.columns if c not in (*KEYS, "frame", "time_ms")]
    last = points.groupBy(*KEYS).agg(F.max("frame").alias("__n"), *[F.max_by(c, "frame").alias(c) for c in channels]).filter(F.col("__n") < frames)
    more = last.withColumn("frame", F.explode(F.sequence(F.col("__n") + 1, F.lit(frames)))).withColumn("time_ms", step_ms * (F.col("frame") - 1))
    return points.unionByName(more.select(*points.columns))


def resize(points: DataFrame, mode: str = "min", step_ms: float = 40.0) -> DataFrame:
    """All traces to one length: the shortest's (min) or the longest's (max)."""
    n = points.groupBy(*KEYS).agg(F.max("frame").alias("n")).agg(F.min("n").alias("min"), F.max("n").alias("max")).first()
    return truncate(points, n["min"]) if mode == "min" else extend(points, n["max"], step_ms)


def total_intensity(points: DataFrame) -> Column:
    return sum((F.coalesce(c, F.lit(0.0)) for c in ("donor", "donor2", "acceptor", "acceptor2") if c in points.columns), F.lit(0.0))


def with_alive(points: DataFrame, zero: str = "threshold") -> DataFrame:
    """total and alive (kept if there): by threshold, by segmental k-means (skm), or until bleaching alone (off)."""
    df = points.withColumn("total", total_intensity(points))
    if "alive" in df.columns:
        return df
    if zero == "skm":
        from lumatrace.operators import states  # it builds on this module

        return states.donor_alive(df)
    return seq.with_donor_alive(df, blink_std=0.0) if zero == "off" else seq.with_donor_alive(df)


def fret_two(points: DataFrame, zero: str = "threshold") -> DataFrame:
    """fret = acceptor / total, 0 where undefined and where the donor is dark as with_alive() has it."""
    df = with_alive(points, zero)
    return df.withColumn("fret", F.when(F.col("alive"), F.coalesce(F.try_divide(F.col("acceptor"), F.col("total")), F.lit(0.0))).otherwise(0.0))


def fret_three(points: DataFrame, geometry: str, zero: str = "threshold") -> DataFrame:
    """fret and fret2 of donor, acceptor and acceptor2: tandem3, independent3, or acceptor/total.

    Undefined values are 0, and so are both where the donor is dark as with_alive() has it. tandem3 also sets fret2 to 0
    where fret is under 0.2 and, if there is a run of more than 5 frames with fret of 0.25 or more, from the end of the last.
    """
    d, a, b = F.col("donor"), F.col("acceptor"), F.col("acceptor2")
    total = d + a + b
    pairs = {"tandem3": ((a + b) / 1, total, b, a + b), "independent3": (a, a + d, b, b + d), "acceptor/total": (a, total, b, total)}[geometry]
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    alive = F.col("alive")
    df = with_alive(points, zero).withColumn("fret", F.when(alive, ratio(*pairs[:2])).otherwise(0.0)).withColumn("fret2", F.when(alive, ratio(*pairs[2:])).otherwise(0.0))
    if geometry == "tandem3":
        df = seq.long_runs(df.withColumn("__high", F.col("fret") >= 0.25), "__high", "__lit")
        end = F.max(F.when(F.col("__lit"), F.col("frame"))).over(seq.whole())
        df = df.withColumn("fret2", F.when((F.col("fret") < 0.2) | F.coalesce(F.col("frame") >= end, F.lit(False)), 0.0).otherwise(F.col("fret2"))).drop("__high", "__lit")
    return df


def stoichiometry(points: DataFrame) -> DataFrame:
    """total / (total + acceptor_direct); null where the donor is dark."""
    total = total_intensity(points)
    return points.withColumn("stoichiometry", F.when(F.col("alive"), F.try_divide(total, total + F.col("acceptor_direct"))))


def rebin(points: DataFrame, factor: float, channels: tuple[str, ...] = ("donor", "acceptor")) -> DataFrame:
    """Frames of `factor` old frames (1 or more), each old frame shared out by overlap; fret anew; incomplete ends dropped."""
    lo, hi = F.col("frame") - 1.0, F.col("frame") * 1.0
    bins = F.sequence(F.floor(F.round(lo / factor, 9)).cast("int"), F.greatest(F.floor(F.round(lo / factor, 9)), F.ceil(F.round(hi / factor, 9)) - 1).cast("int"))
    n = F.max("frame").over(seq.whole())
    parts = points.withColumn("__n", n).withColumn("b", F.explode(bins))
    share = F.least(hi, (F.col("b") + 1) * factor) - F.greatest(lo, F.col("b") * factor)
    parts = parts.filter(F.round((F.col("b") + 1) * factor, 9) <= F.col("__n")).groupBy(*KEYS, (F.col("b") + 1).alias("frame")).agg(*[(F.sum(share * F.col(c)) / factor).alias(c) for c in channels])
    return parts.withColumn("fret", F.coalesce(F.try_divide(F.col("acceptor"), F.col("donor") + F.col("acceptor")), F.lit(0.0)))


def normalized(points: DataFrame, channel: str, first: int = 10, by: list[str] | None = None) -> DataFrame:
    """A channel over its mean in the first frames, by trace (or other columns), as fret."""
    mean = F.avg(F.when(F.col("frame") <= first, F.col(channel))).over(Window.partitionBy(*(by or KEYS)))
    return points.withColumn("fret", F.try_divide(F.col(channel), mean))


def truncation_point(points: DataFrame, rule: str) -> DataFrame:
    """Keys and the frame at which a trace ends: last_fret, first_zero, last_run (more than 5 frames of 0.1 or more), dark_state."""
    n = F.max("frame")
    if rule == "last_run":
        points = seq.long_runs(points.withColumn("__on", F.col("fret") >= 0.1), "__on", "__lit")
    when = lambda c: F.when(c, F.col("frame"))
    value = {
        "last_fret": lambda: F.max(when(F.col("fret") != 0)),
        "first_zero": lambda: F.min(when(F.col("fret") == 0)) - 1,
        "last_run": lambda: F.max(when(F.col("__lit"))),
        "dark_state": lambda: F.min(when(F.col("state") <= 1)) - 1,
    }[rule]()
    return points.groupBy(*KEYS).agg(F.coalesce(value, n).cast("int").alias("end_frame"))


def apply_truncation(points: DataFrame, ends: DataFrame, channel: str = "fret") -> DataFrame:
    """Zero from the end frame on; traces that end at frame 2 or before are left out."""
    df = points.join(ends.filter("end_frame > 2").select(*KEYS, "end_frame"), KEYS)
    return df.withColumn(channel, F.when(F.col("frame") >= F.col("end_frame"), 0.0).otherwise(F.col(channel))).drop("end_frame")


def remove_dark_class(idl: DataFrame) -> DataFrame:
    """States from the first of 1 or 0 on become 0; the others count down by one, to 0 at least."""
    cut = F.min(F.when(F.col("state") <= 1, F.col("frame"))).over(seq.whole())
    return idl.withColumn("state", F.when(F.col("frame") >= cut, 0).otherwise(F.greatest(F.col("state") - 1, F.lit(0))))


def clipped(points: DataFrame, channel: str, low: float, high: float) -> DataFrame:
    return points.withColumn(channel, F.greatest(F.lit(low), F.least(F.lit(high), F.col(channel))))


def with_ids(traces: DataFrame, path: Column | str) -> DataFrame:
    """ids: the recording's path and the trace's number in it."""
    where = F.lit(path) if isinstance(path, str) else path
    rows = ranks.numbered(traces, ["dataset"], "trace_id", "__n")
    return rows.withColumn("ids", F.concat(where, F.lit("#"), F.col("__n"))).drop("__n")


def live_frames(points: DataFrame, channels: tuple[str, ...] = ("donor", "acceptor", "fret")) -> DataFrame:
    """Frames with fret alone, numbered anew from 1 within each trace (n)."""
    return points.filter("fret != 0").select(*KEYS, F.row_number().over(seq.by_frame()).alias("n"), *channels)


def zero_when_dark(points: DataFrame, channels: tuple[str, ...] = ("donor", "acceptor")) -> DataFrame:
    """The channels set to 0 in frames without fret; all frames stay."""
    return points.withColumns({c: F.when(F.col("fret") == 0, 0.0).otherwise(F.col(c)) for c in channels})


def suffixed(path: Column, suffix: str, extension: str | None = None) -> Column:
    """A file's path with a suffix after its base name, its last extension kept or exchanged."""
    own = F.regexp_extract(path, r"(\.[^./\\]*)$", 1) if extension is None else F.lit(extension)
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit(suffix), own)


def trim_titles(files: DataFrame) -> DataFrame:
    """path -> (path, title): base names without extension, and without the words that all have in common at either end.

    A word starts at every character that is no letter or digit; underscores are blanks. Files alike throughout are
    numbered; a title with nothing left is a dash. Only two numbers about all files are sent to the tasks.
    """
    base = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    title = F.trim(F.translate(base, "_", " "))
    words = F.concat(F.array(F.regexp_extract(title, "^[A-Za-z0-9]*", 0)), F.regexp_extract_all(title, F.lit("([^A-Za-z0-9][A-Za-z0-9]*)"), 1))
    df = files.select("path", title.alias("whole"), words.alias("w"))
    df = df.crossJoin(F.broadcast(df.agg(F.max(F.size("w")).alias("most"), F.count("*").alias("files"))))

    def alike(word: Column) -> DataFrame:
        """The number of words, counted from one end, that are the same in all files."""
        cells = df.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("most")))).withColumn("word", F.coalesce(word, F.lit("")))
        seen = cells.groupBy("at").agg(F.max("most").alias("most"), F.countDistinct("word").alias("n"))
        return F.broadcast(seen.agg(F.coalesce(F.min(F.when(F.col("n") > 1, F.col("at"))) - 1, F.max("most")).alias("same")))

    df = df.crossJoin(alike(F.try_element_at("w", F.col("at"))).withColumnRenamed("same", "lead"))
    df = df.withColumn("w", F.slice("w", F.col("lead") + 1, F.greatest(F.lit(0), F.size("w") - F.col("lead"))))
    df = df.crossJoin(alike(F.try_element_at("w", -F.col("at"))).withColumnRenamed("same", "tail"))
    inner = F.trim(F.array_join(F.slice("w", 1, F.greatest(F.lit(0), F.size("w") - F.col("tail"))), ""))
    number = F.row_number().over(Window.orderBy("path"))  # a row for each file
    return df.select("path", F.when(F.col("files") < 2, F.col("whole")).when(F.col("lead") >= F.col("most"), number.cast("string")).when(inner == "", "-").otherwise(inner).alias("title"))


def check_traces(points: DataFrame) -> dict[str, int]:
    """Counts of broken rules: missing keys, repeated frames, gaps, unequal lengths within a dataset."""
    each = points.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("frame").alias("top"), F.countDistinct("frame").alias("distinct"), F.count_if(F.col("frame").isNull()).alias("null_frames"))
    lengths = each.groupBy("dataset").agg((F.max("top") != F.min("top")).cast("int").alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0))).first()[0]
    row = each.agg(*[F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(k) for k, c in (("missing_keys", F.col("dataset").isNull() | F.col("trace_id").isNull() | (F.col("null_frames") > 0)), ("repeated_frames", F.col("n") > F.col("distinct")), ("gaps", F.col("top") > F.col("distinct")))]).first()
    return row.asDict() | {"unequal_lengths": lengths}


#: Channels that traces may have, beside keys, frame and time.
CHANNELS = ["donor", "donor2", "acceptor", "acceptor2", "acceptor_direct", "factor", "factor2", "fret", "fret2", "stoichiometry", "ch1", "ch2", "ch3", "ch4", "total"]


def check_recordings(points: DataFrame, traces: DataFrame) -> dict[str, int]:
    """check_traces() and what joins points to their metadata (traces: keys, ..., a row a trace): unknown and repeated channels, no
    channel of light at all, traces without metadata, metadata without traces, traces with several rows of it."""
    channels = [c for c in points.columns if c not in (*KEYS, "frame", "time_ms")]
    found = check_traces(points) | {"unknown_channels": sum(c not in CHANNELS for c in channels), "repeated_channels": len(channels) - len(set(channels)), "no_light": int(not {"donor", "ch1"} & set(channels))}
    # One row a trace on either side; counts are added up before they meet.
    own = points.groupBy(*KEYS).agg(F.lit(1).alias("__p")).join(traces.groupBy(*KEYS).agg(F.count("*").alias("__t")), KEYS, "full")
    counts = {"without_metadata": F.col("__t").isNull(), "without_points": F.col("__p").isNull(), "repeated_metadata": F.col("__t") > 1}
    row = own.agg(*(F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(k) for k, c in counts.items())).first()
    return found | row.asDict()


def require_valid(points: DataFrame, traces: DataFrame) -> DataFrame:
    """points, if check_recordings() finds no rule broken; else ValueError says which."""
    if broken := {k: n for k, n in check_recordings(points, traces).items() if n}:
        raise ValueError(f"invalid recordings: {broken}")
    return points


def with_defaults(traces: DataFrame) -> DataFrame:
    """Metadata with zero_method, crosstalk and scale, those missing or null set: threshold, none, 1."""
    defaults = {"zero_method": F.lit("threshold"), "crosstalk": F.lit(0.0), "scale": F.lit(1.0)}
    return traces.withColumns({c: F.coalesce(F.col(c), v) if c in traces.columns else v for c, v in defaults.items()})


def frame_span(points: DataFrame, predicate: Column) -> DataFrame:
    """(keys, first, last): the first and last frame of each trace for which a predicate holds, null where it never does."""
    at = F.when(predicate, F.col("frame"))
    return points.groupBy(*KEYS).agg(F.min(at).alias("first"), F.max(at).alias("last"))
