"""MinHash near-duplicates, checked by odd sketches and confirmed on the full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatrace.llm.common import WordHash, keep_by_id, materialize, mix64, shingle_set, utf8
from lumatrace.llm.graph import connected_components

BANDS, ROWS = 24, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Odd-sketch estimates carry sampling error; pairs within this much below the threshold still get the exact check.
MARGIN = 0.15
#: Keys with up to this many rows compare their components pair by pair; larger ones in blocks.
SMALL_KEY = 32
#: Shingles that one block of a large key's members holds (8 bytes each).
BLOCK_SHINGLES = 500_000
#: Rounds in which members that are still apart are offered one hub each, before the rest is compared across components.
HUB_TURNS = 2


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b = (x >> np.uint64(32)).astype(np.uint32).reshape(2, SAMPLES)
    return (a | np.uint32(1))[:, None], b[:, None]


def minhash_samples(shingles: np.ndarray, perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The SAMPLES smallest permuted hashes of a set, in blocks so that memory stays bounded for very long texts."""
    a, b = perms
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(short), 4096):
        np.minimum(out, (a * short[None, i : i + 4096] + b).min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples: each (index, value) flips one of SKETCH_BITS bits. Returned as signed 64-bit words."""
    at = mix64((np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)) | samples.astype(np.uint64)) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def most_differing_bits(similarity: float) -> int:
    """The XOR population count that two sketches of sets this similar are expected to have."""
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * 2 * SAMPLES * (1 - similarity) / SKETCH_BITS)))


def _signatures(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, perms = WordHash(), _permutations()
        fold = mix64(np.arange(1, ROWS + 1, dtype=np.uint64))[None, :]
        number = mix64(np.arange(BANDS, dtype=np.uint64) + np.uint64(1000))
        for batch in batches:
            rows = []
            for text in batch.column("body"):
                s = shingle_set(text.as_py(), n, words)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                low = minhash_samples(s, perms)
                key = mix64((mix64(low.reshape(BANDS, ROWS).astype(np.uint64) + fold) * (fold | np.uint64(1))).sum(axis=1, dtype=np.uint64) + number)
                rows.append((len(s), xxhash.xxh128_digest(s.tobytes()), key.view(np.int64), odd_sketch(low)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(4))], schema=schema)

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch in batches:
            sets = pa.array([shingle_set(x.as_py(), n, words).tobytes() for x in batch.column("body")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], names=["rep", "shingles"])

    return run


def _confirm(percent: int):
    """Pairs with both full sets -> those with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                union = len(np.unique(np.concatenate([a, b]))) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
                keep.append(bool(union) and 100 * (len(a) + len(b) - union) >= percent * union)
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def _meet(percent: int):
    """Members of two blocks of one key (side 0 and 1; or of one block, side 0 alone) -> a link for every two parts that hold one.

    Sketches are compared all at once; only what they leave is intersected, against the other block's sets together.
    """
    most = most_differing_bits(percent / 100 - MARGIN)

    def run(table: pa.Table) -> pa.Table:
        side, rep, part = (table.column(c).to_numpy() for c in ("side", "rep", "part"))
        odd = np.array(table.column("odd").to_pylist(), np.int64).view(np.uint64)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        size = np.array([len(sets[i]) for i in right])
        owner, every = np.repeat(np.arange(len(right)), size), np.concatenate([sets[i] for i in right])
        joined: dict[int, int] = {}

        def root(p: int) -> int:
            while p in joined:
                p = joined[p]
            return p

        found = []
        for i in left:
            s = sets[i]
            near = (part[right] != part[i]) & (100 * np.minimum(size, len(s)) >= percent * np.maximum(size, len(s)))
            near[near] = np.bitwise_count(odd[i][None, :] ^ odd[right[near]]).sum(axis=1) <= most
            near[near] = [root(int(p)) != root(int(part[i])) for p in part[right[near]]]
            if not near.any():
                continue
            rows = near[owner]
            values, whose = every[rows], owner[rows]
            hit = s[np.minimum(np.searchsorted(s, values), len(s) - 1)] == values
            common = np.bincount(whose, hit, len(right)).astype(np.int64)
            for j in right[np.flatnonzero(near & (100 * common >= percent * (size + len(s) - common)))]:
                if (p := root(int(part[j]))) != (q := root(int(part[i]))):
                    joined[p] = q
                    found.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pa.table({"src": pa.array([f[0] for f in found], pa.int64()), "dst": pa.array([f[1] for f in found], pa.int64())})

    return run


def _large_keys(placed: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links between components within large keys. placed: (key, rep, part) of those keys; whole: (rep, odd, shingles).

    Each key's members are dealt into blocks of bounded size, by component; small components share blocks. Only blocks of
    different components (or shared ones) meet, so what one large component holds is never compared within itself, no
    pair of members is ever a row, and no task holds more than two blocks.
    """
    weigh = whole.select("rep", (F.octet_length("shingles") / 8).alias("weight"))
    placed = materialize(placed.join(weigh, "rep"), "large")
    heavy = placed.groupBy("key", "part").agg(F.sum("weight").alias("w")).withColumn("own", F.when(F.col("w") >= BLOCK_SHINGLES // 4, F.col("part")).otherwise(-1))
    lots = heavy.groupBy("key", "own").agg(F.ceil(F.sum("w") / BLOCK_SHINGLES).alias("lots"))
    dealt = placed.join(heavy.select("key", "part", "own"), ["key", "part"]).join(lots, ["key", "own"]).withColumn("lot", F.pmod(F.xxhash64("rep"), F.col("lots")))
    dealt = materialize(dealt.select("key", "rep", "part", "own", "lot"), "dealt")
    blocks = dealt.select("key", "own", "lot").distinct()
    meet = (F.col("own") < F.col("own2")) | ((F.col("own") == -1) & (F.col("own2") == -1) & (F.col("lot") <= F.col("lot2")))
    pairs = materialize(blocks.join(blocks.toDF("key", "own2", "lot2"), "key").filter(meet).withColumn("task", F.xxhash64("key", "own", "lot", "own2", "lot2")), "block_pairs")
    one = dealt.join(pairs.select("key", "own", "lot", "task"), ["key", "own", "lot"]).select("task", "rep", "part", F.lit(0).alias("side"))
    other = pairs.filter("own != own2 or lot != lot2").select("key", F.col("own2").alias("own"), F.col("lot2").alias("lot"), "task")
    two = dealt.join(other, ["key", "own", "lot"]).select("task", "rep", "part", F.lit(1).alias("side"))
    return one.union(two).join(whole, "rep").groupBy("task").applyInArrow(_meet(percent), "src long, dst long")


def _verify(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (src, dst) -> confirmed links: odd sketches first, then the full sets of what is left."""
    differ = sum((F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    a, b = (whole.select(F.col("rep").alias(k), F.col("odd").alias(v)) for k, v in (("src", "x"), ("dst", "y")))
    near = pairs.join(a, "src").join(b, "dst").filter(differ <= most_differing_bits(percent / 100 - MARGIN)).select("src", "dst")
    a, b = (whole.select(F.col("rep").alias(k), F.col("shingles").alias(v)) for k, v in (("src", "set_a"), ("dst", "set_b")))
    return materialize(near, "near").join(b, "dst").join(a, "src").mapInArrow(_confirm(percent), "src long, dst long")


def _ordered(a: str, b: str) -> list[F.Column]:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def _with_stars(links: DataFrame, parts: DataFrame) -> DataFrame:
    """New links beside those found before, which count as one link from each node to its component."""
    return links.union(parts.select(F.col("node").alias("src"), F.col("component").alias("dst")))


def _placed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(key, rep, part, n) of the keys whose n members are in more than one component."""
    placed = materialize(members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("part")), "placed")
    split = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n")).filter("p != q").select("key", "n")
    return placed.join(materialize(split, "split"), "key")


def _offers(placed: DataFrame, turn: int) -> DataFrame:
    """One pair at most for each member: with the hub of one of its keys that is in another component.

    A key's hub is its smallest id in the first turn, later one drawn by hash. Of its keys' hubs a member takes the
    smallest (later: one drawn by hash), so the pairs of a cluster of any size and of all its keys are at most its members.
    """
    order = F.col("rep") if turn == 0 else F.xxhash64("key", "rep", F.lit(turn))
    hubs = materialize(placed.groupBy("key").agg(F.min(F.struct(order.alias("order"), F.col("rep").alias("hub"), F.col("part").alias("hub_part"))).alias("h")).select("key", "h.hub", "h.hub_part"), "hubs")
    apart = placed.join(hubs, "key").filter("hub_part != part")
    choice = F.col("hub") if turn == 0 else F.xxhash64("rep", "hub", F.lit(turn))
    return apart.groupBy("rep").agg(F.min(F.struct(choice.alias("order"), F.col("hub"))).alias("h")).select(*_ordered("rep", "h.hub")).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest linked id), kept (it is that id).

    docs needs doc_id (distinct) and text; other columns are ignored. A null or blank text has no shingles and is
    linked with nothing; so is a row without doc_id, whose component_id is null and which is kept. Where a doc_id is
    repeated, each row is placed by its own text. Texts with the same set form one class and only its smallest id takes
    part in the search, so that exact copies cost one aggregation. Of classes that share a band key, each is first
    compared with one hub, never all with all; those still apart are offered another hub; what hubs leave in different
    components within a key is then compared across those components alone, in small keys pair by pair, in large ones
    block by block. An empty table gives no rows.
    """
    texts = docs.select("doc_id", utf8("text").alias("body"))
    signed = materialize(texts.mapInArrow(_signatures(shingle_words), "doc_id long, n_shingles long, set_digest binary, bands array<long>, odd array<long>"), "signatures")
    own = signed.filter("set_digest is not null and doc_id is not null")
    reps = materialize(own.groupBy("set_digest").agg(F.min("doc_id").alias("rep")), "classes")
    first = own.join(reps, "set_digest").filter("doc_id = rep")
    keys = materialize(first.select(F.explode("bands").alias("key"), "rep").distinct(), "keys")
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared")
    members = materialize(keys.join(shared, "key", "left_semi"), "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = keep_by_id(texts, wanted, "left_semi").mapInArrow(_sets(shingle_words), "rep long, shingles binary")
    whole = materialize(sets.join(first.select("rep", "odd"), "rep"), "sets")

    parts, placed = None, members.select("key", "rep", F.col("rep").alias("part"))
    for turn in range(HUB_TURNS):
        new = materialize(_verify(_offers(placed, turn), whole, percent), "links")
        parts = connected_components(new if parts is None else _with_stars(new, parts))
        placed = materialize(_placed(members, parts), "placed")

    small = placed.filter(F.col("n") <= SMALL_KEY)
    other = small.select("key", F.col("rep").alias("other"), F.col("part").alias("other_part"))
    across = small.join(other, "key").filter("part < other_part").select(*_ordered("rep", "other")).distinct()
    more = _verify(across, whole, percent)
    large = placed.filter(F.col("n") > SMALL_KEY).select("key", "rep", "part")
    if large.limit(1).count():
        more = more.union(_large_keys(large, whole, percent))
    more = materialize(more, "links")
    if more.limit(1).count():
        parts = connected_components(_with_stars(more, parts))

    rep_part = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("set_digest", F.coalesce("component", "rep").alias("part"))
    out = signed.join(rep_part, "set_digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("part", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the near duplicates that near_duplicates() does not keep; columns unchanged."""
    gone = near_duplicates(docs, shingle_words, percent).filter(~F.col("kept")).select("doc_id")
    return keep_by_id(docs, materialize(gone, "gone"), "left_anti")
