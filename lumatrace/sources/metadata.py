"""The metadata page of binary trace files: nested typed fields as rows of a table, and back.

A row holds one value: dataset (path), scope (file or trace), trace_id (null for the file's), field (`a.b` inside structures,
`a[2].b` inside arrays of them, `a{2}` inside cells), type (name of the stored type), dims, numbers (all numeric and
logical types but 64-bit whole numbers, down the columns) or text (characters; 64-bit whole numbers, comma-joined).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatrace.schema import KEYS
from lumatrace.sources import files

# Type names by code, and the numpy type of each numeric one.
TYPES = ["char", "uint8", "uint16", "uint32", "uint64", "int8", "int16", "int32", "int64", "single", "double", "logical", "cell", "struct"]
NUMPY = {"uint8": "<u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8", "int8": "<i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "single": "<f4", "double": "<f8", "logical": "<u1"}

ROWS = "dataset string, scope string, trace_id long, field string, type string, dims array<int>, numbers array<double>, text string"
_COLUMNS = ["dataset", "scope", "trace_id", "field", "type", "dims", "numbers", "text"]

#: A value: its type, its sizes, and a string, an array down the columns, a list of values (cell) or of dicts of values (struct).
Value = tuple[str, list[int], Any]


def _unpack(packed: Value, n: int) -> list[Value]:
    """A field's values of n structures from the one array that they were joined to."""
    kind, dims, content = packed
    if kind == "char":
        parts = content.split(files.SEPARATOR)
        if len(parts) != n:
            raise ValueError("packed strings don't match their structures")
        return [("char", [1, len(p)], p) for p in parts]
    scalars = sum(d > 1 for d in dims) == 1
    own = [1, 1] if scalars else dims[:-1]
    return [(kind, own, part) for part in np.asarray(content).reshape(n, -1)]


def decode(data: bytes, at: int = 0) -> tuple[Value | None, int]:
    """The value at a place, and where the next begins; None for an unknown type, which is passed over."""
    code, size = struct.unpack_from("<BI", data, at)
    at += 5
    end = at + size
    if code >= len(TYPES):
        return None, end
    kind, n_dims = TYPES[code], data[at]
    dims = list(struct.unpack_from(f"<{n_dims}I", data, at + 1))
    at += 1 + 4 * n_dims
    n = int(np.prod(dims, dtype=np.int64))
    if kind == "char":
        raw = data[at:end]
        try:
            content: Any = raw.decode()
        except UnicodeDecodeError:
            content = raw.decode("latin-1")
        at = end
    elif kind == "cell":
        content = []
        for _ in range(n):
            value, at = decode(data, at)
            content.append(value)
    elif kind == "struct":
        content = [{} for _ in range(n)]
        fields, at = data[at], at + 1
        for _ in range(fields):
            name = data[at + 1 : at + 1 + data[at]].decode()
            at += 1 + data[at]
            packed, at = data[at] & 1, at + 1
            if packed:
                value, at = decode(data, at)
                values = [None] * n if value is None else _unpack(value, n)
            else:
                values = []
                for _ in range(n):
                    value, at = decode(data, at)
                    values.append(value)
            for element, value in zip(content, values, strict=True):
                element[name] = value
    else:
        kind_of = np.dtype(NUMPY[kind])
        content = np.frombuffer(data, kind_of, n, at)
        at += n * kind_of.itemsize
    if at != end:
        raise ValueError("a metadata page's size does not match its content")
    return (kind, dims, content), end


def _packed(values: list[Value | None]) -> Value | None:
    """One array for the same field of all structures, where all are strings, or arrays of one type and size."""
    first = values[0]
    if any(v is None or v[0] != first[0] for v in values):
        return None
    if first[0] == "char":
        if any(files.SEPARATOR in v[2] for v in values):
            return None
        joined = files.SEPARATOR.join(v[2] for v in values)
        return "char", [1, len(joined)], joined
    if first[0] not in NUMPY or len(values) < 2 or len(first[1]) != 2 or 0 in first[1] or any(v[1] != first[1] for v in values):
        return None
    return first[0], [*first[1], len(values)], np.concatenate([np.asarray(v[2]) for v in values])


def encode(value: Value) -> bytes:
    kind, dims, content = value
    head = struct.pack(f"<B{len(dims)}I", len(dims), *dims)
    if kind == "char":
        body = content.encode()
    elif kind == "cell":
        body = b"".join(encode(v) for v in content if v is not None)
    elif kind == "struct":
        names = list(content[0]) if content else []
        body = struct.pack("<B", len(names))
        for name in names:
            values = [element.get(name) for element in content]
            packed = _packed(values)
            raw = name.encode()
            body += struct.pack("<B", len(raw)) + raw + struct.pack("<B", packed is not None)
            body += encode(packed) if packed is not None else b"".join(encode(v if v is not None else ("double", [0, 0], [])) for v in values)
    else:
        body = np.asarray(content).astype(NUMPY[kind]).tobytes()
    return struct.pack("<BI", TYPES.index(kind), len(head) + len(body)) + head + body


def _flat(value: Value | None, name: str) -> Iterator[tuple[str, str, list[int], list[float] | None, str | None]]:
    if value is None:
        return
    kind, dims, content = value
    if kind == "struct" and dims == [1, 1]:
        for field, inner in content[0].items():
            yield from _flat(inner, f"{name}.{field}" if name else field)
    elif kind in ("struct", "cell") and content:
        for i, inner in enumerate(content, start=1):
            yield from _flat(("struct", [1, 1], [inner]) if kind == "struct" else inner, f"{name}[{i}]" if kind == "struct" else f"{name}{{{i}}}")
    elif kind in ("char", "struct", "cell"):
        yield name, kind, dims, None, content if kind == "char" else None
    elif kind in ("uint64", "int64"):
        yield name, kind, dims, None, ",".join(map(str, np.asarray(content).tolist()))
    else:
        yield name, kind, dims, np.asarray(content, float).tolist(), None


def rows_of(path: str, root: Value | None) -> Iterator[tuple]:
    """Rows of one file's metadata."""
    fields = root[2][0] if root else {}
    for name, kind, dims, numbers, text in _flat(fields.get("fileMetadata"), ""):
        yield path, "file", None, name, kind, dims, numbers, text
    for i, one in enumerate((fields.get("traceMetadata") or ("struct", [0], []))[2], start=1):
        for name, kind, dims, numbers, text in _flat(("struct", [1, 1], [one]), ""):
            yield path, "trace", i, name, kind, dims, numbers, text


_STEP = re.compile(r"([^.\[\]{}]+)|\[(\d+)\]|\{(\d+)\}")


def _nested(rows: list[tuple]) -> Value:
    """The structure that rows of (field, type, dims, numbers, text) describe."""
    tree: dict = {}
    for field, *own in rows:
        at = tree
        steps = [(m.group(1), m.group(2), m.group(3)) for m in _STEP.finditer(field)]
        for name, element, cell in steps:
            at = at.setdefault(("f", name) if name else ("s", int(element)) if element else ("c", int(cell)), {})
        at["value"] = own

    def build(node: dict) -> Value:
        if "value" in node:
            kind, dims, numbers, text = node["value"]
            if kind in ("uint64", "int64"):
                return kind, dims, [int(x) for x in (text or "").split(",") if x]
            return kind, dims, text or "" if kind == "char" else [] if kind in ("cell", "struct") else numbers or []
        if next(iter(node))[0] == "f":
            return "struct", [1, 1], [{name: build(inner) for (_, name), inner in node.items()}]
        members = [build(node[k]) for k in sorted(node)]
        return ("struct", [1, len(members)], [m[2][0] for m in members]) if next(iter(node))[0] == "s" else ("cell", [1, len(members)], members)

    return build(tree) if tree else ("struct", [1, 1], [{}])


def page(rows: list[tuple], n_traces: int) -> bytes:
    """The metadata page of one file from rows of (scope, trace number, field, type, dims, numbers, text)."""
    own = _nested([r[2:] for r in rows if r[0] == "file"])
    by_trace: dict[int, list[tuple]] = {}
    for r in rows:
        if r[0] == "trace":
            by_trace.setdefault(r[1], []).append(r[2:])
    each = [_nested(by_trace.get(i, []))[2][0] for i in range(1, n_traces + 1)]
    names = list(dict.fromkeys(name for e in each for name in e))
    traces = ("struct", [1, n_traces], [{name: e.get(name) for name in names} for e in each])
    return encode(("struct", [1, 1], [{"fileMetadata": own, "traceMetadata": traces}]))


def decode_root(data: bytes, at: int) -> Value | None:
    """The metadata of a file whose page begins at a place; None if there is none, or an empty one."""
    return decode(data, at)[0] if len(data) >= at + 6 else None


def read_metadata(spark: SparkSession, path: str, glob: str = "*.{traces,rawtraces}") -> DataFrame:
    """Metadata of all trace files under a path, of all versions, a row for each value (see the module's text)."""
    from lumatrace.sources import legacy

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"], strict=True):
                rows = list(rows_of(name, legacy.decode_any(bytes(data)).root))
                if rows:
                    yield pd.DataFrame(rows, columns=_COLUMNS).astype({"trace_id": "Int64"})

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", "content").mapInPandas(run, ROWS)


def trace_table(metadata: DataFrame) -> DataFrame:
    """One row a trace: dataset, trace_id, texts (map of strings), numbers (map of arrays), sizes (map of the arrays' dims)."""
    own = metadata.filter("scope = 'trace'")
    entry = lambda v: F.map_from_entries(F.collect_list(F.when(F.col(v).isNotNull(), F.struct("field", v))))
    return own.withColumn("sizes", F.when(F.col("numbers").isNotNull(), F.col("dims"))).groupBy(*KEYS).agg(entry("text").alias("texts"), entry("numbers").alias("numbers"), entry("sizes").alias("sizes"))


def export_traces(points: DataFrame, metadata: DataFrame, channels: tuple[str, ...] = ("donor", "acceptor", "fret"), most: int = 5000) -> DataFrame:
    """(dataset, content): files.export_traces() with each file's metadata page, from rows as read_metadata() gives them.

    Values of a trace go with it into its file, under its number there; values of the file into every file of the dataset.
    """
    filed = files.filed(points.select(*KEYS, "frame", "time_ms", *channels), most)
    places = files.filed(points.select(*KEYS).distinct().withColumn("__own", F.col("dataset")), most).select(F.col("dataset").alias("__file"), "segment", F.col("trace_id"), F.col("__own").alias("dataset"))
    of_traces = metadata.filter("scope = 'trace'").join(places, KEYS).select(F.col("__file").alias("dataset"), "scope", F.col("segment").cast("long").alias("trace_id"), *_COLUMNS[3:])
    of_files = metadata.filter("scope = 'file'").join(places.select("dataset", "__file").distinct(), "dataset").select(F.col("__file").alias("dataset"), "scope", "trace_id", *_COLUMNS[3:])

    def run(f: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame({"dataset": [], "content": []})
        f = f.sort_values(["trace_id", "frame"])
        n = f["trace_id"].nunique()
        if len(f) % n or f.groupby("trace_id").size().nunique() != 1:
            raise ValueError("traces of one file must be equally long")
        data = files.encode_traces(f["time_ms"].to_numpy()[: len(f) // n], {c: f[c].to_numpy(float).reshape(n, -1) for c in channels}, b"")
        rows = [(r.scope, None if pd.isna(r.trace_id) else int(r.trace_id), r.field, r.type, [int(d) for d in r.dims], None if r.numbers is None else list(r.numbers), r.text) for r in m.sort_values(["scope", "trace_id", "field"]).itertuples()]
        return pd.DataFrame({"dataset": [f["dataset"].iloc[0]], "content": [data + page(rows, n)]})

    return filed.groupBy("dataset").cogroup(of_traces.unionByName(of_files).groupBy("dataset")).applyInPandas(run, "dataset string, content binary")
