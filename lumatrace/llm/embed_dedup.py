"""Near-duplicate embeddings: NN-descent over tight balls of vectors, an audit of its recall, and exact threshold links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatrace.llm.common import materialize
from lumatrace.llm.graph import connected_components

#: Neighbours that a list starts with, tables of the first guess, rows of a block compared with each other.
NEIGHBOURS, TABLES, BLOCK = 8, 12, 192
#: Balls whose links the audit finds by comparing them with all, rounds of descent, links a ball beyond which descent gives up.
AUDIT_ROWS, MOST_ROUNDS, DENSE = 4000, 5, 64
#: Rows of one code that are gathered together; larger codes are cut by hash.
CODE_ROWS = 4000
#: Pivots that balls are dealt to, bytes of one block's vectors in single precision, rows compared with a block at once.
PIVOTS, BLOCK_BYTES, STRIP = 1000, 8 << 20, 512
#: Rounds in which balls that different codes parted are merged again.
MERGES = 5
#: Angles are computed to about 1e-8; bounds built on them leave this much.
SLACK = 1e-6


def _planes(dim: int, table: int, bits: int) -> np.ndarray:
    return np.random.default_rng((dim, table, 11)).standard_normal((dim, bits))


#: Length of vectors -> their mean.
Means = dict[int, np.ndarray]


def _codes(x: np.ndarray, table: int, bits: int, means: Means) -> np.ndarray:
    """On which sides of random planes through the mean each row lies: rows that crowd in one direction are parted too."""
    return (((x - means[x.shape[1]]) @ _planes(x.shape[1], table, bits) > 0) @ (1 << np.arange(bits))).astype(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array, at=None, kind=np.float64) -> np.ndarray:
    values = column.to_pylist() if at is None else column.take(pa.array(at)).to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _by_dim(dims: np.ndarray) -> list[np.ndarray]:
    return [np.flatnonzero(dims == d) for d in np.unique(dims)]


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles of unit vectors row by row; precise for small ones."""
    return 2 * np.arcsin(np.clip(np.linalg.norm(a - b, axis=1) / 2, 0, 1))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, dims, out = [], [], []
        for i, e in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            if i is None or not e or any(x is None for x in e):
                continue
            v = np.array(e, np.float64)
            top = np.abs(v).max()
            if not np.isfinite(top) or top == 0:
                continue
            v = v / top
            ids.append(i)
            dims.append(len(v))
            out.append((v / np.sqrt(v @ v)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "v"])


_BALL = "vec_id long, leader long, dim int, code long, v binary"
_BALL_NAMES = ["vec_id", "leader", "dim", "code", "v"]


def _gather(ids: np.ndarray, x: np.ndarray, leaders: dict, key, close: float) -> tuple[np.ndarray, list[int]]:
    """Each row to a leader within `close`, or a new leader: leader ids, and the rows that lead."""
    own, vectors = leaders.get(key, (np.empty(0, np.int64), np.empty((0, x.shape[1]))))
    lead, new = np.full(len(ids), -1, np.int64), []
    open_rows = np.arange(len(ids))
    if len(own):
        best = (x @ vectors.T).argmax(axis=1)
        a = _angles(x, vectors[best])
        near = a <= close
        lead[near] = own[best[near]]
        open_rows = open_rows[~near]
    while len(open_rows):
        first = open_rows[0]
        a = _angles(x[open_rows], x[first][None])
        near = a <= close
        near[0] = True
        lead[open_rows[near]] = ids[first]
        new.append(first)
        open_rows = open_rows[~near]
    if new:
        leaders[key] = (np.concatenate([own, ids[new]]), np.concatenate([vectors, x[new]]))
    return lead, new


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for rows in _by_dim(batch.column("dim").to_numpy()):
            x = _matrix(batch.column("v"), rows)
            own = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1])])
            own[0] += len(x)
            own[1] += x.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([v.tobytes() for _, v in total.values()], pa.binary())], names=["dim", "n", "total"])


def _mean(table: pa.Table) -> pa.Table:
    order = table.sort_by([("n", "ascending"), ("total", "ascending")])  # a fixed order, so that a task run again adds up alike
    mean = _matrix(order.column("total")).sum(axis=0) / sum(order.column("n").to_pylist())
    return pa.table({"dim": table.column("dim").slice(0, 1), "mean": pa.array([mean.tobytes()], pa.binary())})


def _means(units: DataFrame) -> Means:
    """A mean for each length of vectors."""
    rows = units.mapInArrow(_sums, "dim int, n long, total binary").groupBy("dim").applyInArrow(_mean, "dim int, mean binary").collect()
    return {r["dim"]: np.frombuffer(r["mean"]) for r in rows}


def _ball_rows(table: pa.Table | pa.RecordBatch, leaders: dict, close: float, coding: int, bits: int, means: Means) -> pa.RecordBatch:
    ids, dims = table.column("vec_id").to_numpy(), table.column("dim").to_numpy()
    lead, code = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    is_lead = np.zeros(len(ids), bool)
    for rows in _by_dim(dims):
        x = _matrix(table.column("v"), rows)
        c = code[rows] = _codes(x, 1000 + coding, bits, means)
        order = np.argsort(c, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(c[order])) + 1):
            a, new = _gather(ids[rows[part]], x[part], leaders, (x.shape[1], int(c[part[0]])), close)
            lead[rows[part]] = a
            is_lead[rows[part[new]]] = True
    v = [x if y else None for x, y in zip(table.column("v").to_pylist(), is_lead, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lead), pa.array(dims), pa.array(code), pa.array(v, pa.binary())], names=_BALL_NAMES)


def _local_balls(close: float, bits: int, means: Means):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders: dict = {}
        for batch in batches:
            if sum(len(x[0]) for x in leaders.values()) > 100_000:  # balls only compress; starting anew loses nothing
                leaders = {}
            if len(batch):
                yield _ball_rows(batch, leaders, close, 0, bits, means)

    return run


def _coded(turn: int, bits: int, means: Means):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros(len(batch), np.int64)
            for rows in _by_dim(batch.column("dim").to_numpy()):
                code[rows] = _codes(_matrix(batch.column("v"), rows), 1000 + turn, bits, means)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "leader", "dim")), pa.array(code), batch.column("v")], names=_BALL_NAMES)

    return run


def _merge_balls(close: float, turn: int, bits: int, means: Means):
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_ball_rows(table.select(_BALL_NAMES).sort_by("vec_id"), {}, close, turn, bits, means)])

    return run


def _bits(n: int) -> int:
    """Code length at which some tens of vectors share a code."""
    return max(6, min(40, math.ceil(math.log2(max(2, n / 32)))))


def _balls(units: DataFrame, close: float, means: Means) -> tuple[DataFrame, DataFrame]:
    """(vec_id, rep), (rep, dim, v, size, radius, least): balls of vectors within `close` of one of them, their exact radii.

    Each task folds its own rows first, so that a group of copies of any size reaches the merging rounds as a few rows.
    """
    n = units.count()
    local = materialize(units.mapInArrow(_local_balls(close, _bits(min(n, 50_000)), means), _BALL), "balls")
    members, lead = local.select("vec_id", F.col("leader").alias("rep")), local.filter("v is not null")
    bits = _bits(lead.count())
    shards = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 20_000)
    for turn in range(1, MERGES + 1):
        coded = materialize(lead.select("vec_id", "leader", "dim", "v").mapInArrow(_coded(turn, bits, means), _BALL), "coded")
        hot = materialize(coded.groupBy("dim", "code").agg(F.ceil(F.count("*") / CODE_ROWS).alias("cuts")).filter("cuts > 1"), "hot_codes")
        piece = F.pmod(F.xxhash64("vec_id"), F.coalesce("cuts", F.lit(1)))
        dealt = coded.join(hot, ["dim", "code"], "left").select(*_BALL_NAMES, F.pmod(F.xxhash64("code", piece), F.lit(shards)).alias("shard"), piece.alias("piece"))
        merged = materialize(dealt.groupBy("shard", "piece").applyInArrow(_merge_balls(close, turn, bits, means), _BALL), "merged")
        moved = merged.select(F.col("vec_id").alias("rep"), F.col("leader").alias("to"))
        members = members.join(moved, "rep").select("vec_id", F.col("to").alias("rep"))
        lead = merged.filter("v is not null")
    # Chains of leaders may have carried a member too far from the last one: then it is a ball of its own.
    lead = lead.select(F.col("vec_id").alias("rep"), "v")
    far = members.join(lead.select("rep", F.col("v").alias("b")), "rep").join(units.select("vec_id", F.col("v").alias("a")), "vec_id")
    far = materialize(far.select(F.col("vec_id").alias("u"), F.col("rep").alias("w"), "a", "b").mapInArrow(_cosines, "u long, w long, cosine double, angle double"), "members")
    near = F.col("angle") <= close
    members = far.select(F.col("u").alias("vec_id"), F.when(near, F.col("w")).otherwise(F.col("u")).alias("rep"), F.when(near, F.col("angle")).otherwise(0.0).alias("angle"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("size"), F.max("angle").alias("radius"), F.min("vec_id").alias("least"))
    return members.select("vec_id", "rep"), materialize(units.select(F.col("vec_id").alias("rep"), "dim", "v").join(sizes, "rep"), "reps")


def _floors(reach: np.ndarray, other: np.ndarray, dim: int) -> np.ndarray:
    """Least cosine at which two balls may hold a link, less the rounding of single precision; reach: half the threshold's angle plus the ball's radius."""
    return np.cos(np.minimum(np.pi, reach[:, None] + other[None, :] + SLACK)) - max(1e-5, 1.2e-7 * dim)


_PLACED = "rep long, cell int, reach double, span double, v binary"


def _place(pivots: dict[int, tuple[int, np.ndarray]], alone: dict[int, int]):
    """Each ball to the cell of its nearest pivot; span: the angle from there within which a partner's pivot's span must come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, reach = batch.column("dim").to_numpy(), batch.column("reach").to_numpy()
            cell, span = np.zeros(len(batch), np.int32), np.full(len(batch), 2 * np.pi)
            for rows in _by_dim(dims):
                d = int(dims[rows[0]])
                if d in pivots:
                    first, vectors = pivots[d]
                    x = _matrix(batch.column("v"), rows)
                    best = (x @ vectors.T).argmax(axis=1)
                    cell[rows], span[rows] = first + best, _angles(x, vectors[best]) + reach[rows]
                else:
                    cell[rows] = alone[d]
            short = [np.frombuffer(v, np.float64).astype(np.float32).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(cell), pa.array(reach), pa.array(span), pa.array(short, pa.binary())], names=["rep", "cell", "reach", "span", "v"])

    return run


def _meet(table: pa.Table) -> pa.Table:
    """All pairs of balls of two blocks (or of one block with itself) that may hold a link."""
    block, ids, reach = (table.column(c).to_numpy() for c in ("block", "rep", "reach"))
    x = _matrix(table.column("v"), kind=np.float32)
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    us, ws = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(0, len(left), STRIP):
        rows = left[i : i + STRIP]
        r, s = np.nonzero(x[rows] @ x[right].T >= _floors(reach[rows], reach[right], x.shape[1]))
        u, w = ids[rows[r]], ids[right[s]]
        keep = u < w if block.min() == block.max() else u != w
        us.append(u[keep])
        ws.append(w[keep])
    u, w = np.concatenate(us), np.concatenate(ws)
    return pa.table({"u": np.minimum(u, w), "w": np.maximum(u, w)})


def _top(ids: np.ndarray, reach: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of a block's cosine matrix: each row's k best others, and all others that may link."""
    dim = 1 << 10  # rounding bound of the block's single precision
    np.fill_diagonal(cosine, -2)
    k = min(k, len(ids) - 1)
    near = cosine >= _floors(reach, reach, dim)
    keep = near.copy()
    np.put_along_axis(keep, np.argpartition(-cosine, k - 1, axis=1)[:, :k], True, axis=1)
    keep &= cosine > -2
    r, c = np.nonzero(keep)
    return ids[r], ids[c], cosine[r, c], near[r, c]


_EDGE = "u long, w long, c double, near boolean"


def _edge_table(parts: list[tuple]) -> pa.Table:
    kinds = (np.int64, np.int64, np.float64, bool)
    return pa.table({n: (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, t)).astype(t) for i, (n, t) in enumerate(zip("u w c near".split(), kinds, strict=True))})


def _deal(tables: list[int], bits: int, means: Means):
    """Each ball to one bucket of every table of codes: (key, rep, reach, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, ids, reach = batch.column("dim").to_numpy(), batch.column("rep").to_numpy(), batch.column("reach").to_numpy()
            for rows in _by_dim(dims):
                x = _matrix(batch.column("v"), rows)
                short = pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())
                for t in tables:
                    key = (np.int64(t) << 52) + (np.int64(x.shape[1] % 4096) << 40) + _codes(x, t, bits, means)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[rows]), pa.array(reach[rows]), short], names=["key", "rep", "reach", "v"])

    return run


def _blocks(table: pa.Table) -> pa.Table:
    """Within each key, in blocks of rows that project alike: every row's best others of its block."""
    keys, ids, reach = (table.column(c).to_numpy() for c in ("key", "rep", "reach"))
    sizes, out = np.array([len(b) for b in table.column("v").to_pylist()]), []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = _matrix(table.column("v"), rows, np.float32)
        turn = int(keys[rows[0]] >> 52) if len(rows) else 0
        side = x @ _planes(x.shape[1], 999 + turn, 1)[:, 0].astype(np.float32)
        order = np.lexsort((ids[rows], side, keys[rows]))
        for part in np.split(order, np.flatnonzero(np.diff(keys[rows][order])) + 1):
            for i in range(0, len(part), BLOCK):
                p = part[i : i + BLOCK]
                if len(p) > 1:
                    out.append(_top(ids[rows[p]], reach[rows[p]], x[p] @ x[p].T, NEIGHBOURS))
    return _edge_table(out)


def _local_join(table: pa.Table) -> pa.Table:
    """At each node, its neighbours meet: pairs that would enter either one's list, or that may link."""
    table = table.sort_by([("at", "ascending"), ("rep", "ascending")])
    at, ids, worst, reach = (table.column(c).to_numpy() for c in ("at", "rep", "worst", "reach"))
    values, out = table.column("v").to_pylist(), []
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
        if len(part) > 1:
            x = np.frombuffer(b"".join([values[i] for i in part]), np.float32).reshape(len(part), -1)
            c = x @ x.T
            np.fill_diagonal(c, -2)
            near = c >= _floors(reach[part], reach[part], x.shape[1])
            r, s = np.nonzero(((c > worst[part][:, None] + 1e-6) | near) & (c > -2))
            out.append((ids[part[r]], ids[part[s]], c[r, s], near[r, s]))
    return _edge_table(out)


def _best(edges: DataFrame) -> DataFrame:
    """Each node's NEIGHBOURS best; a list whose entries may all link grows until it holds every one that may."""
    each = edges.groupBy("u", "w").agg(F.max("c").alias("c"), F.max("near").alias("near"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("c"), "w"))
    return each.withColumn("rank", rank).filter((F.col("rank") <= NEIGHBOURS) | F.col("near"))


def _round(graph: DataFrame, nodes: DataFrame, number: int, shards: int) -> DataFrame:
    """One NN-descent step: forward and reverse neighbours of every node meet there. Long lists send another share each round."""
    worst = graph.groupBy("u").agg(F.min(F.when(F.col("rank") <= NEIGHBOURS, F.col("c"))).alias("worst"))
    nodes = nodes.withColumnRenamed("rep", "u").join(worst, "u", "left").select(F.col("u").alias("rep"), "v", "reach", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    both = graph.select(F.col("u").alias("at"), F.col("w").alias("rep")).union(graph.select(F.col("w").alias("at"), F.col("u").alias("rep"))).distinct()
    turn = F.row_number().over(Window.partitionBy("at").orderBy(F.xxhash64("at", "rep", F.lit(number))))
    both = both.withColumn("turn", turn).filter(F.col("turn") <= 2 * NEIGHBOURS).select("at", "rep")
    both = both.union(graph.select(F.col("u").alias("at"), F.col("u").alias("rep")).distinct())
    met = both.join(nodes, "rep").select("at", "rep", "worst", "reach", "v", F.pmod(F.xxhash64("at"), F.lit(shards)).alias("shard"))
    return met.groupBy("shard").applyInArrow(_local_join, _EDGE)


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        short = [np.frombuffer(v, np.float64).astype(np.float32).tobytes() for v in batch.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("reach"), pa.array(short, pa.binary())], names=["rep", "reach", "v"])


def _audit(reps: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """All pairs (u, w) that AUDIT_ROWS balls, drawn by hash, may link with, by comparing them with every ball; and their number."""
    asked = nodes.orderBy(F.xxhash64("rep")).limit(AUDIT_ROWS).collect()  # bounded by AUDIT_ROWS
    groups = [[r for r in asked if r.dim == d] for d in sorted({r.dim for r in asked})]
    sent = reps.sparkSession.sparkContext.broadcast([(g[0].dim, np.array([r.rep for r in g]), np.array([r.reach for r in g]), np.stack([np.frombuffer(r.v) for r in g])) for g in groups])

    def against_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, dims, ids, far = [], batch.column("dim").to_numpy(), batch.column("rep").to_numpy(), batch.column("reach").to_numpy()
            for dim, own, reach, x in sent.value:
                rows = np.flatnonzero(dims == dim)
                if len(rows):
                    c = x @ _matrix(batch.column("v"), rows).T
                    r, s = np.nonzero(c >= _floors(reach, far[rows], dim) + 2 * max(1e-5, 1.2e-7 * dim))
                    keep = own[r] != ids[rows[s]]
                    parts.append((own[r[keep]], ids[rows[s[keep]]], c[r, s][keep], np.ones(keep.sum(), bool)))
            yield from _edge_table(parts).to_batches()

    truth = materialize(nodes.mapInArrow(against_all, _EDGE).select("u", "w"), "truth")
    return truth, truth.count()


def _descent(reps: DataFrame, means: Means, recall: float) -> tuple[DataFrame, float | None]:
    """Pairs (u, w), u < w, of balls that may hold a link, by NN-descent, and the share of the audit's pairs among them: None where
    that is no measure, as pairs were still gained when rounds ended, or the audit saw none.

    Buckets of random planes give every ball a first list of neighbours. In each round the neighbours of every ball, in
    either direction, meet there and enter each other's lists where they are closer than what those hold. A list is
    saturated when all its entries may link: it then grows to hold all that may. Rounds end when the audit is content and
    nothing is gained any more; after MOST_ROUNDS, or once there are more than DENSE pairs a ball that may link, they end unsettled.
    """
    spark, n = reps.sparkSession, reps.count()
    bits, shards = max(1, min(39, _bits(n) - 1)), max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 2000)
    nodes = reps.select("rep", "dim", "reach", "v")
    short = materialize(reps.select("rep", "reach", "v").mapInArrow(_shorten, "rep long, reach double, v binary"), "short")
    truth, wanted = _audit(reps, nodes)

    def dealt(tables: list[int]) -> DataFrame:
        keyed = nodes.mapInArrow(_deal(tables, bits, means), "key long, rep long, reach double, v binary")
        return keyed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards * 4))).groupBy("shard").applyInArrow(_blocks, _EDGE)

    graph, last, found, settled = materialize(_best(dealt(list(range(1, TABLES + 1)))), "graph"), -1, 0, False
    for number in range(MOST_ROUNDS):
        more = graph.select("u", "w", "c", "near").union(_round(graph, short, number, shards))
        if number > 1:  # the audit was not content with descent alone: new tables
            more = more.union(dealt(list(range(1 + TABLES * (number - 1), 1 + TABLES * number))))
        graph = materialize(_best(more), "graph")
        pairs = graph.filter("near").select("u", "w")
        now = pairs.count()
        found = truth.join(pairs.union(pairs.select("w", "u")).distinct(), ["u", "w"], "left_semi").count()
        settled = found >= recall * wanted and now <= last
        if settled or now > DENSE * n:
            break
        last = now
    pairs = pairs.union(truth).select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")).distinct()
    return materialize(pairs, "descent"), found / wanted if settled and wanted else None


def _exhaustive(reps: DataFrame) -> DataFrame:
    """All pairs (u, w), u < w, of balls that may hold a link: none is left out.

    Balls are dealt to the cells of pivots. Two cells meet unless the triangle inequality rules out every link between
    them; a cell of any size is cut into blocks, and every two blocks of cells that meet are compared in one task.
    """
    spark = reps.sparkSession
    counts = {r["dim"]: r["n"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    n = sum(counts.values())
    if not n:
        return reps.select(F.col("rep").alias("u"), F.col("rep").alias("w"))
    most = max(1024, min(BLOCK_BYTES // (4 * max(counts)), n // 16))
    sample = reps.select("rep", "dim", "v").orderBy(F.xxhash64("rep"), "rep").limit(min(PIVOTS, max(16, n // most))).collect()  # bounded by PIVOTS
    pivots, cells = {}, 0
    for d in sorted({r["dim"] for r in sample}):
        x = np.stack([np.frombuffer(r["v"]) for r in sample if r["dim"] == d])
        pivots[d] = (cells, x)
        cells += len(x)
    alone = {d: cells + i for i, d in enumerate(sorted(set(counts) - set(pivots)))}
    placed = materialize(reps.select("rep", "dim", "reach", "v").mapInArrow(_place(pivots, alone), _PLACED), "cells")
    found = {r["cell"]: (r["n"], r["span"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("span").alias("span")).collect()}
    blocks, start, at = {}, {}, 0
    for c in sorted(found):
        blocks[c], start[c] = math.ceil(found[c][0] / most), at
        at += blocks[c]
    meet = [(c, c) for c in alone.values()]
    for d, (first, x) in pivots.items():
        own = np.array([c for c in range(first, first + len(x)) if c in found])
        spans = np.array([found[c][1] for c in own])
        apart = 2 * np.arcsin(np.clip(np.sqrt(np.maximum(0, 2 - 2 * (x[own - first] @ x[own - first].T))) / 2, 0, 1))
        i, j = np.nonzero(apart <= spans[:, None] + spans[None, :] + 2 * SLACK)
        meet += [(int(c), int(e)) for c, e in zip(own[i], own[j], strict=True)] + [(int(c), int(c)) for c in own]
    meet = sorted(set(meet))
    partners = spark.createDataFrame(pa.table({"cell": pa.array([c for c, _ in meet], pa.int32()), "own_start": [start[c] for c, _ in meet], "own_n": [blocks[c] for c, _ in meet], "start": [start[e] for _, e in meet], "n": [blocks[e] for _, e in meet]}))
    dealt = placed.join(F.broadcast(partners), "cell").withColumn("block", F.col("own_start") + F.pmod(F.xxhash64("rep"), F.col("own_n")))
    dealt = dealt.select("rep", "reach", "v", "block", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("other"))
    dealt = dealt.select("rep", "reach", "v", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return dealt.groupBy("lo", "hi").applyInArrow(_meet, "u long, w long")


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = [float(np.frombuffer(a) @ np.frombuffer(b)) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        d = [float(np.linalg.norm(np.frombuffer(a) - np.frombuffer(b))) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        angle = 2 * np.arcsin(np.clip(np.array(d) / 2, 0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("w"), pa.array(c, pa.float64()), pa.array(angle, pa.float64())], names=["u", "w", "cosine", "angle"])


def _exact(pairs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Pairs (u, w) with their cosine and angle in double precision."""
    a, b = (vectors.select(F.col(key).alias(k), F.col("v").alias(n)) for k, n in (("u", "a"), ("w", "b")))
    return pairs.join(a, "u").join(b, "w").select("u", "w", "a", "b").mapInArrow(_cosines, "u long, w long, cosine double, angle double")


def _search(reps: DataFrame, means: Means, recall: float) -> DataFrame:
    """The pairs that descent finds; if it misses more of the audit's than `recall` allows, or that is not known, those that all cells hold."""
    pairs, share = _descent(reps, means, recall)
    return pairs if share is not None and share >= recall else _exhaustive(reps)


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 1.0) -> DataFrame:
    """One row for each row of `vectors`: vec_id, n_links, component_id, kept.

    vectors needs vec_id (distinct) and embedding; other columns are ignored. Vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing (n_links 0, their own component), and vectors of different lengths
    not with each other. Rows without vec_id have a null component and are kept.

    Vectors first gather in balls so tight that all members of one link; a group of copies of any size so becomes one
    node, and links between balls are counted by size where the triangle inequality proves all of them (or none), else
    checked member by member. Pairs of balls that may link are found by NN-descent. An audit compares AUDIT_ROWS balls
    with all others. Where descent has missed more than 1 - `recall` of what the audit found, its pairs are not used: balls are
    dealt to pivots, and any two cells that the triangle inequality does not part are compared in full, block against
    block, which misses nothing but is quadratic in the number of balls where pivots part little. With the default, one
    missed link of the audited balls is enough for that. No pair below the threshold is ever linked. Where a vec_id is
    repeated, the least of its vectors (by length, then bytes) counts for all of its rows. An empty table gives no rows.
    """
    theta = math.acos(threshold)
    units = materialize(vectors.select("vec_id", "embedding").mapInArrow(_units, "vec_id long, dim int, v binary"), "units")
    if units.groupBy("vec_id").count().filter("count > 1").limit(1).count():
        units = materialize(units.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("u")).select("vec_id", "u.dim", "u.v"), "units")
    means = _means(units)
    members, reps = _balls(units, theta / 2 - SLACK, means)
    pairs = _exact(_search(reps.withColumn("reach", F.col("radius") + theta / 2), means, recall), reps, "rep")
    size = reps.select("rep", "size", "radius")
    pairs = pairs.join(size.toDF("u", "su", "ru"), "u").join(size.toDF("w", "sw", "rw"), "w")
    reach = F.col("ru") + F.col("rw") + F.when((F.col("su") == 1) & (F.col("sw") == 1), 0.0).otherwise(SLACK)
    kind = F.when((F.col("su") == 1) & (F.col("sw") == 1), F.when(F.col("cosine") >= threshold, "all")).when(F.col("angle") + reach <= theta, "all").when(F.col("angle") - reach <= theta, "some")
    pairs = materialize(pairs.withColumn("kind", kind).filter("kind is not null"), "pairs")
    whole, part = pairs.filter("kind = 'all'"), pairs.filter("kind = 'some'").select("u", "w")

    inside = members.select("vec_id", "rep")
    open_pairs = part.join(inside.toDF("x", "u"), "u").join(inside.toDF("y", "w"), "w").select("u", "w", "x", "y")
    checked = materialize(_exact(open_pairs.select(F.col("x").alias("u"), F.col("y").alias("w")), units, "vec_id").filter(F.col("cosine") >= threshold).select("u", "w"), "checked")
    single = checked.select("u").union(checked.select("w")).toDF("vec_id").groupBy("vec_id").agg(F.count("*").alias("some"))
    joined = checked.join(inside.toDF("u", "ru"), "u").join(inside.toDF("w", "rw"), "w").select("ru", "rw")
    by_ball = whole.select(F.col("u").alias("rep"), F.col("sw").alias("n")).union(whole.select("w", "su")).groupBy("rep").agg(F.sum("n").alias("others"))
    parts = connected_components(whole.select("u", "w").union(joined).toDF("src", "dst"))
    placed = reps.select("rep", "size", "least").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    lowest = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    balls = placed.join(by_ball, "rep", "left").join(lowest, "part").select("rep", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component_id")
    known = inside.join(balls, "rep").join(single, "vec_id", "left").select("vec_id", (F.col("links") + F.coalesce("some", F.lit(0))).alias("links"), "component_id")
    out = vectors.select("vec_id").join(known, "vec_id", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
