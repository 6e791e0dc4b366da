"""Files of traces, dwell times and movies, read and written as Spark jobs over many files: one file is one task's unit."""

from __future__ import annotations

import re
import struct
import uuid
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumatrace.functions import ranks
from lumatrace.schema import KEYS

# Fixed values of the binary trace format: magic, version, numeric type codes and the separator of packed strings.
MAGIC, VERSION, SINGLE, SEPARATOR = b"TRCS", 5, 9, "\x1f"
_TYPES = ["char", "u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8", "f4", "f8", "bool"]

POINTS = "dataset string, trace_id long, frame int, time_ms double, donor double, acceptor double, acceptor2 double, acceptor_direct double, factor double, fret double, fret2 double, stoichiometry double"
_CHANNELS = {"donor": "donor", "acceptor": "acceptor", "acceptor2": "acceptor2", "acceptorDirect": "acceptor_direct", "factor": "factor", "fret": "fret", "fret2": "fret2", "stoichiometry": "stoichiometry"}


def encode_traces(time: np.ndarray, channels: dict[str, np.ndarray], page: bytes = b"\0") -> bytes:
    """One file: header, channel names, time axis, then each channel traces-first, single precision, and the metadata page."""
    n, m = next(iter(channels.values())).shape
    names = SEPARATOR.join(channels).encode()
    head = struct.pack("<I4sHBBII", 0, MAGIC, VERSION, SINGLE, len(channels), n, m) + struct.pack("<I", len(names)) + names
    return head + time.astype("<f4").tobytes() + b"".join(c.astype("<f4").tobytes(order="F") for c in channels.values()) + page


def header(data: bytes) -> dict:
    """Sizes and channel names, from the start of a file."""
    zero, magic, version, kind, k, n, m = struct.unpack_from("<I4sHBBII", data)
    if zero or magic != MAGIC or kind not in (SINGLE, SINGLE + 1):
        raise ValueError("not a binary trace file")
    size = struct.unpack_from("<I", data, 20)[0]
    names = data[24 : 24 + size].decode().strip(SEPARATOR).split(SEPARATOR)
    if len(names) != k:
        raise ValueError("channel names don't match their count")
    return {"version": version, "type": "<f4" if kind == SINGLE else "<f8", "n_traces": n, "n_frames": m, "channels": names, "at": 24 + size}


def decode_traces(data: bytes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    return decode_all(data)[:2]


def decode_all(data: bytes) -> tuple[np.ndarray, dict[str, np.ndarray], int]:
    """Time axis, channels, and the place where the metadata page begins."""
    h = header(data)
    kind, n, m, at = np.dtype(h["type"]), h["n_traces"], h["n_frames"], h["at"]
    time = np.frombuffer(data, kind, m, at).astype(float)
    at += m * kind.itemsize
    channels = {}
    for name in h["channels"]:
        channels[name] = np.frombuffer(data, kind, n * m, at).reshape((n, m), order="F").astype(float)
        at += n * m * kind.itemsize
    return time, channels, at


def point_rows(path: str, time: np.ndarray, channels: dict[str, np.ndarray], only: set[int] | None) -> Iterator[pd.DataFrame]:
    n, m = next(iter(channels.values())).shape
    own = np.arange(n) if only is None else np.array([i for i in range(n) if i + 1 in only], np.int64)
    many = max(1, 20_000 // max(1, m))  # traces of one frame of rows
    for at in range(0, len(own), many):
        part = own[at : at + many]
        rows = {"dataset": path, "trace_id": np.repeat(part + 1, m), "frame": np.tile(np.arange(1, m + 1, dtype=np.int32), len(part)), "time_ms": np.tile(time, len(part))}
        for name, column in _CHANNELS.items():
            rows[column] = channels[name][part].ravel() if name in channels else None
        out = pd.DataFrame(rows)
        yield out.astype({c: "float64" for c in _CHANNELS.values()})


def read_traces(spark: SparkSession, path: str, only: list[int] | None = None, glob: str = "*.{traces,rawtraces}") -> DataFrame:
    """trace_points of all binary trace files under a path; `only`: trace numbers, those beyond a file's end passed over."""
    wanted = None if only is None else set(only)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"], strict=True):
                yield from point_rows(name, *decode_traces(bytes(data)), wanted)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, POINTS)


def size_catalog(spark: SparkSession, path: str, glob: str = "*.{traces,rawtraces}") -> DataFrame:
    """path, n_traces, n_frames, channels of each file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            heads = [header(bytes(d)) for d in f["head"]]
            yield pd.DataFrame({"path": f["path"], "n_traces": [h["n_traces"] for h in heads], "n_frames": [h["n_frames"] for h in heads], "channels": [h["channels"] for h in heads]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.substring("content", 1, 65_536).alias("head")).mapInPandas(run, "path string, n_traces int, n_frames int, channels array<string>")


def filed(df: DataFrame, most: int) -> DataFrame:
    """df (keys, ...) with `segment`, its trace's number in its file: files hold at most `most` traces, the next are dataset-2, dataset-3, ..."""
    n = ranks.numbered(df.select(*KEYS).distinct(), ["dataset"], "trace_id", "__n")
    part, name = F.floor((F.col("__n") - 1) / most), F.col("dataset")
    n = n.select(*KEYS, F.when(part == 0, name).otherwise(F.concat(name, F.lit("-"), (part + 1).cast("string"))).alias("__file"), (F.pmod(F.col("__n") - 1, F.lit(most)) + 1).cast("int").alias("segment"))
    return df.join(n, KEYS).withColumn("dataset", F.col("__file")).drop("__file")


def whole(df: DataFrame, names: DataFrame, number: str, most: int = 5000) -> DataFrame:
    """df of files as filed() cuts them (dataset, `number` ...), under the datasets' own names again, numbers counted on over each one's files.

    names: the datasets (dataset), by which `a-2`, the second file of `a`, is told from a dataset of that name.
    """
    cut = r"^(.*)-([0-9]+)$"
    own = names.select(F.col("dataset").alias("__own")).distinct()
    df = df.join(own, F.col("dataset") == F.col("__own"), "left").withColumn("__next", F.col("__own").isNull() & F.col("dataset").rlike(cut)).drop("__own")
    before = F.when(F.col("__next"), (F.regexp_extract("dataset", cut, 2).cast("long") - 1) * most).otherwise(0)
    of = F.when(F.col("__next"), F.regexp_extract("dataset", cut, 1)).otherwise(F.col("dataset"))
    kind = df.schema[number].dataType
    return df.withColumns({number: (F.col(number) + before).cast(kind), "dataset": of}).drop("__next")


def export_traces(points: DataFrame, channels: tuple[str, ...] = ("donor", "acceptor", "fret"), most: int = 5000) -> DataFrame:
    """(dataset, content): each dataset as the bytes of binary files of at most `most` traces, in order. Traces must be equally long."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["trace_id", "frame"])
        n = f["trace_id"].nunique()
        m = len(f) // n
        if len(f) != n * m:
            raise ValueError("traces of one file must be equally long")
        data = encode_traces(f["time_ms"].to_numpy()[:m], {c: f[c].to_numpy(float).reshape(n, m) for c in channels})
        return pd.DataFrame({"dataset": [f["dataset"].iloc[0]], "content": [data]})

    parted = filed(points.select(*KEYS, "frame", "time_ms", *channels), most)
    return parted.groupBy("dataset").applyInPandas(run, "dataset string, content binary")


def read_legacy_text(spark: SparkSession, path: str) -> DataFrame:
    """White-space text files: a time line, then donor, acceptor and fret lines for each trace, each after an optional id."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("dataset"), F.posexplode(F.split(F.trim("value"), r"\r?\n")).alias("line", "text"))
    cells = F.split(F.trim("text"), r"\s+")
    numbers = F.transform(F.filter(cells, lambda x: x.rlike(r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$")), lambda x: x.cast("double"))
    lines = lines.select("dataset", "line", numbers.alias("x"))
    time = lines.filter("line = 0").select("dataset", F.col("x").alias("time"))
    kind = F.element_at(F.array(F.lit("donor"), F.lit("acceptor"), F.lit("fret")), ((F.col("line") - 1) % 3 + 1).cast("int"))
    rows = lines.filter("line > 0").select("dataset", (F.floor((F.col("line") - 1) / 3) + 1).cast("long").alias("trace_id"), kind.alias("kind"), "x")
    wide = rows.groupBy(*KEYS).agg(*[F.max(F.when(F.col("kind") == k, F.col("x"))).alias(k) for k in ("donor", "acceptor", "fret")]).join(time, "dataset")
    zipped = F.arrays_zip("time", "donor", "acceptor", "fret")
    return wide.select(*KEYS, F.posexplode(zipped).alias("at", "v")).select(*KEYS, (F.col("at") + 1).alias("frame"), F.col("v.time").alias("time_ms"), "v.donor", "v.acceptor", "v.fret")


def read_dwells(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, segment, dwell_no, state, n_frames, sampling_ms) of dwell-time text files; states from 1, empty segments dropped."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("dataset"), F.posexplode(F.split("value", "Segment:")).alias("at", "part")).filter("at > 0")
    lines = F.split("part", r"\r?\n")
    head = whole.select("dataset", F.regexp_extract("part", r"^\s*([0-9]+)", 1).cast("int").alias("segment"), F.regexp_extract("part", r"Sampling\(ms\):\s*([0-9.]+)", 1).cast("double").alias("sampling_ms"), F.posexplode(F.slice(lines, 2, F.size(lines))).alias("n", "line"))
    cells = F.split(F.trim("line"), r"\s+")
    rows = head.filter(F.col("line").rlike(r"^\s*[0-9]+\s+[0-9.]+")).select("dataset", "segment", "n", "sampling_ms", (cells[0].cast("int") + 1).alias("state"), F.round(cells[1].cast("double") / F.col("sampling_ms")).cast("int").alias("n_frames"))
    return rows.withColumn("dwell_no", F.row_number().over(Window.partitionBy("dataset", "segment").orderBy("n"))).drop("n")


def dwell_text(dwells: DataFrame, model: list[tuple[float, float]], sampling_ms: float, most: int = 5000) -> DataFrame:
    """(dataset, value): each dataset's dwells as the text of dwell-time files of at most `most` segments, named as export_traces() names them."""
    if any(b[0] <= a[0] for a, b in zip(model, model[1:], strict=False)):
        warnings.warn("the model's means don't increase: state numbers may not follow fret", stacklevel=2)
    tail = " ".join(f"{m:g} {s:g}" for m, s in model)
    each = filed(dwells.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("dwell_no", "state", "start_frame", "n_frames"))).alias("d")), most)
    line = lambda r: F.format_string("%d\t%d", r["state"] - 1, F.round(r["n_frames"] * sampling_ms).cast("long"))
    text = F.concat(F.format_string(f"Segment: %d Dwells: %d Sampling(ms): {sampling_ms:g} Start(ms): %d ClassCount: {len(model)} {tail}\n", F.col("segment"), F.size("d"), ((F.col("d")[0]["start_frame"] - 1) * sampling_ms).cast("long")), F.array_join(F.transform("d", line), "\n"), F.lit("\n"))
    seg = each.withColumn("text", text)
    return seg.groupBy("dataset").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("trace_id", "text"))), lambda r: r["text"]), "").alias("value"))


def with_companions(traces: DataFrame, dwells: DataFrame, required: bool = False) -> DataFrame:
    """Trace files (path) with the dwell file of the same base name: .qub.dwt if there is one, else .dwt."""
    base = lambda c: F.regexp_replace(c, r"(\.rawtraces|\.traces|\.qub\.dwt|\.dwt)$", "")
    kinds = dwells.groupBy(base(F.col("path")).alias("base")).agg(F.max(F.when(F.col("path").endswith(".qub.dwt"), F.col("path"))).alias("q"), F.max(F.when(~F.col("path").endswith(".qub.dwt"), F.col("path"))).alias("p"))
    out = traces.select("path", base(F.col("path")).alias("base")).join(kinds, "base", "left").select("path", F.coalesce("q", "p").alias("dwell_path"))
    if required and (missing := out.filter("dwell_path is null").limit(1).collect()):
        raise FileNotFoundError(missing[0]["path"])
    return out


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Paths and times of the files under a folder whose names match a pattern, in either case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "length").filter(F.element_at(F.split("path", "/"), -1).rlike(f"(?i){pattern}"))


def read_movie(spark: SparkSession, path: str, glob: str = "*.pma", kind: str = "<u2") -> DataFrame:
    """pixels of raw movies: width and height as unsigned 16-bit numbers, then frames row by row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"], strict=True):
                data = bytes(data)
                nx, ny = struct.unpack_from("<HH", data)
                step = nx * ny * np.dtype(kind).itemsize
                y, x = np.divmod(np.arange(nx * ny), nx)
                for i in range((len(data) - 4) // step):
                    v = np.frombuffer(data, kind, nx * ny, 4 + i * step)
                    yield pd.DataFrame({"movie": name, "frame": i + 1, "channel": 1, "y": y, "x": x, "intensity": v.astype(float)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, "movie string, frame int, channel int, y int, x int, intensity double")


def concatenated(pixels: DataFrame, movie: str) -> DataFrame:
    """Movies as one, in order of their names, frames counted on."""
    n = pixels.groupBy("movie").agg(F.max("frame").alias("n"))
    start = n.select("movie", (F.sum("n").over(Window.orderBy("movie")) - F.col("n")).alias("start"))  # a row for each movie
    return pixels.join(start, "movie").select(F.lit(movie).alias("movie"), (F.col("frame") + F.col("start")).cast("int").alias("frame"), "channel", "y", "x", "intensity")


def selection_list(spark: SparkSession, path: str) -> DataFrame:
    """trace_id of each number in a space-separated text file."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("word")).filter(F.col("word").rlike("^[0-9]+$"))
    return words.select(F.col("word").cast("long").alias("trace_id"))


def clipped_lines(points: DataFrame, channel: str = "fret", low: float = -0.5, high: float = 1.0) -> DataFrame:
    """(dataset, trace_id, frame, line): one channel of the frames above 0.001 as lines of text, clipped to [low, high], six digits."""
    value = F.greatest(F.lit(low), F.least(F.lit(high), F.col(channel)))
    return points.filter(F.col(channel) > 0.001).select(*KEYS, "frame", F.round(value * 1_000_000).cast("long").cast("string").alias("line"))


def ranked_path(points: DataFrame, channel: str = "fret", dark: float = 0.1) -> DataFrame:
    """States (keys, frame, state) from a fitted path: values under `dark` are 0, and a trace's distinct values are numbered upwards."""
    level = F.when(F.col(channel) < dark, 0.0).otherwise(F.col(channel))
    return points.withColumn("__level", level).select(*KEYS, "frame", F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("__level")).alias("state"))


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header: statistics, a row for each picked trace; or the data of a plot."""
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", "true").schema(schema).csv(path)


def write_plot_data(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a summary under its name: contours, histograms, transition densities."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}")


def save_files(named: DataFrame, folder: str, extension: str) -> None:
    """(dataset, content) -> one file each, written by the tasks into a folder that all executors see.

    The folder may be on any store that Arrow's file systems open by its scheme (hdfs, viewfs, s3, gs, ...; s3a counts as s3);
    others are refused. Without a scheme, or with file:, it must be a folder that all executors mount.
    """

    def put(rows: Iterator) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder)) if re.match("[a-z0-9]+:", folder) else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for r in rows:
            target = f"{root.rstrip('/')}/" + "".join(c if c.isalnum() or c in "-_." else "_" for c in r["dataset"]) + extension
            temporary = f"{target}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(bytes(r["content"]))
            store.move(temporary, target)  # a task that runs twice leaves one whole file

    named.select("dataset", "content").foreachPartition(put)


def wide_blocks(points: DataFrame, block: int = 100, columns: tuple[str, ...] = ("donor", "acceptor", "fret")) -> DataFrame:
    """Wide text of any number of traces: a row for each range of `block` trace ids (part) and frame, a column for each of its traces.

    Columns are named by the trace's place in its part, 1_donor to <block>_fret, so their number is fixed before any data is read.
    """
    place = F.pmod(F.col("trace_id") - 1, F.lit(block))
    cells = [F.max(F.when(place == i, F.col(c))).alias(f"{i + 1}_{c}") for i in range(block) for c in columns]
    return points.groupBy("dataset", F.floor((F.col("trace_id") - 1) / block).alias("part"), "frame").agg(*cells)


def text_lines(points: DataFrame, mu: tuple[float, ...], block: int = 100, columns: tuple[str, ...] = ("donor", "acceptor")) -> DataFrame:
    """Text export of any number of traces, a line for each trace and frame; part: a range of `block` trace ids, to partition files by.

    idl is the trace's mean fret over the frames of the line's state, or that state's `mu` if it has none; state 0 counts as 1.
    """
    state = F.greatest(F.lit(1), F.col("state"))
    mean = F.avg(F.when(F.col("state") > 0, F.col("fret"))).over(Window.partitionBy("dataset", "trace_id", state))
    idl = F.coalesce(mean, F.element_at(F.array(*[F.lit(float(m)) for m in mu]), state))
    part = F.floor((F.col("trace_id") - 1) / block)
    return points.select("dataset", part.alias("part"), "trace_id", "frame", (F.col("time_ms") / 1000).alias("time_s"), "fret", idl.alias("idl"), *columns)
