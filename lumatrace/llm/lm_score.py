"""Language-model scores: stupid backoff over count tables of the corpus itself, partitioned by hash and joined to its n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatrace.llm.common import WordHash, materialize, ngram_hashes, utf8

BACKOFF = 0.4
#: Words (seen twice or more) whose counts are broadcast, 16 bytes each; beyond it they are joined to each text's words.
BROADCAST_WORDS = 4_000_000
#: Word pairs that one partition of the pair counts is planned for.
PARTITION_PAIRS = 2_000_000
#: Texts that a task handles together.
GROUP = 1000
#: At most 1 / FREQUENT words take more than that share of a sample; pairs of two of them are counted in a dense table.
FREQUENT, FREQUENT_SAMPLE = 1000, 2000


def _words(text: bytes, known: WordHash) -> np.ndarray:
    split = text.lower().split()
    return np.fromiter(map(known.__getitem__, split), np.uint64, len(split))


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each key among sorted ones, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _count_pass(frequent: np.ndarray):
    """Counts within each batch: kind 0, words by hash; kind 1, pairs of two frequent words by index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            texts = [_words(t.as_py(), known) for t in batch.column("body")]
            words = np.concatenate([*texts, np.empty(0, np.uint64)])
            start = np.zeros(len(words) + 1, bool)
            start[np.cumsum([0, *map(len, texts)])] = True
            at, there = _place(frequent, words)
            both = there[:-1] & there[1:] & ~start[1 : len(words)] if len(words) else there[:0]
            pairs = at[:-1][both] * len(frequent) + at[1:][both]
            for kind, keys in ((0, words.view(np.int64)), (1, pairs.astype(np.int64))):
                k, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    return run


class _Counts:
    """Lookup of total counts: words seen twice or more by their hash; others were seen once."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.n = keys[order], n[order]

    def of(self, words: np.ndarray) -> np.ndarray:
        at, there = _place(self.keys, words)
        return np.where(there, self.n[at] if len(self.n) else 1, 1)


_ROW = "part int, grp long, docs array<long>, words array<long>, base array<double>, hits array<long>, hash binary, gain binary, times binary, doc binary"
_ROW_SCHEMA = pa.schema([("part", pa.int32()), ("grp", pa.int64()), ("docs", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("hits", pa.list_(pa.int64())), ("hash", pa.binary()), ("gain", pa.binary()), ("times", pa.binary()), ("doc", pa.binary())])


def _explode_pass(sent, parts: int, total: int, distinct: int):
    """Each group of texts -> a row of its own (part -1) and a row of its pairs for each partition of the pair counts.

    A pair is sent once for each text with the times it occurs there and, in single precision, what its log score gains
    if the pair turns out to occur in another text: minus the history's log count, minus the backed-off score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        frequent, dense, table = sent.value
        task, count = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, len(whole), GROUP):
                batch = whole.slice(at, GROUP)
                ids, bodies = batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()
                n_words, base, hits, out = [], [], [], []
                for d, body in enumerate(bodies):
                    counts = table or _Counts(*(np.array(batch.column(c)[d].as_py() or [], np.int64) for c in ("keys", "counts")))
                    w = _words(body, known)
                    n_words.append(len(w))
                    hits.append(0)
                    if not len(w):
                        base.append(0.0)
                        continue
                    u, inverse, own = np.unique(w, return_inverse=True, return_counts=True)
                    left = counts.of(u.view(np.int64)) - own
                    single = np.log((left + 1) / (total - len(w) + distinct + 1))[inverse]
                    if len(w) == 1:
                        base.append(float(single[0]))
                        continue
                    p, first, times = np.unique(ngram_hashes(w, 2), return_index=True, return_counts=True)
                    missed = math.log(BACKOFF) + single[first + 1]
                    gain = -np.log(np.maximum(left[inverse[first]], 1)) - missed
                    score = float(single[0] + (times * missed).sum())
                    a, b = _place(frequent, w[first].view(np.uint64)), _place(frequent, w[first + 1])
                    both = a[1] & b[1]
                    other = dense[a[0][both], b[0][both]] - times[both]
                    seen = other > 0
                    score += float((times[both][seen] * (np.log(other[seen]) + gain[both][seen])).sum())
                    hits[-1] = int(times[both][seen].sum())
                    base.append(score)
                    p, times, gain = p[~both], times[~both], gain[~both]
                    out.append((p, gain.astype(np.float32), times.astype(np.uint32), np.full(len(p), d, np.uint16)))
                grp, count = (task << 32) + count, count + 1
                rows = [(-1, grp, ids, n_words, base, hits, None, None, None, None)]
                if out:
                    p, gain, times, doc = (np.concatenate([o[i] for o in out]) for i in range(4))
                    part = ((p >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    for rows_of in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                        if len(rows_of):
                            rows.append((int(part[rows_of[0]]), grp, None, None, None, None, p[rows_of].tobytes(), gain[rows_of].tobytes(), times[rows_of].tobytes(), doc[rows_of].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROW_SCHEMA)], schema=_ROW_SCHEMA)

    return run


_SUM = "grp long, part int, docs array<long>, words array<long>, base array<double>, hits array<long>"
_SUM_SCHEMA = pa.schema([f for n in ("grp", "part", "docs", "words", "base", "hits") for f in _ROW_SCHEMA if f.name == n])


def _join_counts(table: pa.Table) -> pa.Table:
    """One partition: its pair counts, joined to its pairs; gains of those that other texts hold too, by group and text."""
    part = table.column("part")[0].as_py()
    if part < 0:
        return table.select(_SUM_SCHEMA.names)
    grp = table.column("grp").to_pylist()
    get = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
    hashes, gains, times, docs = get("hash", np.uint64), get("gain", np.float32), get("times", np.uint32), get("doc", np.uint16)
    t = np.concatenate(times).astype(np.int64)
    _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    other = np.bincount(inverse, t).astype(np.int64)[inverse] - t
    seen = other > 0
    gain = np.where(seen, t * (np.log(np.maximum(other, 1)) + np.concatenate(gains)), 0.0)
    hit, rows, at = np.where(seen, t, 0), [], 0
    for g, d in zip(grp, docs, strict=True):
        own = slice(at, at + len(d))
        at += len(d)
        rows.append((g, part, None, None, np.bincount(d, gain[own]), np.bincount(d, hit[own]).astype(np.int64)))
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SUM_SCHEMA)], schema=_SUM_SCHEMA)


_SCORE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_pairs_seen", pa.int64()), ("log_score", pa.float64())])


def _sum_up(table: pa.Table) -> pa.Table:
    """One group of texts: its own row and those of all partitions, added up in the partitions' order."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    own = rows[0]
    score, hits = np.array(own["base"]), np.array(own["hits"], np.int64)
    for r in rows[1:]:
        score[: len(r["base"])] += r["base"]
        hits[: len(r["hits"])] += np.array(r["hits"], np.int64)
    return pa.table([own["docs"], own["words"], hits, np.round(score, 6) + 0.0], schema=_SCORE)


def score_corpus(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_pairs_seen, log_score, score (mean log score of a word).

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. Counts come from all rows of docs; from what a text is scored with, its
    own words are taken off (else every pair would have been seen). A word after another scores log(pair / history) if the
    pair occurs in another text, else log(BACKOFF) plus its own score, log((count + 1) / (words + distinct words + 1)); the
    first word has its own score. The step from one to the other travels in single precision (seven digits).

    docs needs doc_id and text; other columns are ignored. Texts that are null or blank have 0 words, log_score 0 and a
    null score; a null doc_id is passed on; repeated rows count as texts of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", utf8("text").alias("body"))
    n_docs = texts.count()
    # The sample only decides which pairs are counted in the dense table; results don't depend on it.
    sample = texts.sample(min(1.0, FREQUENT_SAMPLE / max(1, n_docs)), 5).mapInArrow(_count_pass(np.empty(0, np.uint64)), "kind int, key long, n long")
    common = sample.groupBy("key").agg(F.sum("n").alias("n"))
    least = (common.agg(F.sum("n")).first()[0] or 0) / FREQUENT
    frequent = np.sort(np.array([r.key for r in common.filter(F.col("n") > least).collect()], np.int64).view(np.uint64))  # fewer than FREQUENT
    counted = materialize(texts.mapInArrow(_count_pass(frequent), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words = counted.filter("kind = 0")
    distinct, total, repeated = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    dense = np.zeros((len(frequent), len(frequent)), np.int64)
    for r in counted.filter("kind = 1").toLocalIterator():  # at most FREQUENT squared
        dense[divmod(r.key, len(frequent))] = r.n
    kept = words.filter("n > 1").select("key", "n")
    table = None
    if repeated <= BROADCAST_WORDS:
        own = kept.toArrow()
        table = _Counts(own["key"].to_numpy(), own["n"].to_numpy())
        del own
    else:
        texts = _with_counts(texts, kept)
    sent = spark.sparkContext.broadcast((frequent, dense, table))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION_PAIRS)
    exploded = texts.mapInArrow(_explode_pass(sent, parts, total, distinct), _ROW)
    own = F.when(F.col("part") < 0, -1 - F.pmod(F.col("grp"), F.lit(parts))).otherwise(F.col("part"))
    joined = exploded.withColumn("at", own).groupBy("at").applyInArrow(_only(_join_counts, _ROW_SCHEMA.names), _SUM)
    scored = joined.groupBy("grp").applyInArrow(_sum_up, "doc_id long, n_words long, n_pairs_seen long, log_score double")
    return scored.withColumn("score", F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)))


def _only(function, names: list[str]):
    return lambda table: function(table.select(names))


def _hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHash()
    for batch in batches:
        for at in range(0, len(batch), GROUP):
            part = batch.slice(at, GROUP)
            keys = [np.unique(_words(t.as_py(), known)).view(np.int64) for t in part.column("body")]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("__row").to_numpy(), list(map(len, keys)))), pa.array(np.concatenate([*keys, np.empty(0, np.int64)]))], names=["__row", "key"])


def _with_counts(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """texts with the counts of each one's own words (keys, counts), by joins: for vocabularies too large to broadcast."""
    numbered = materialize(texts.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = numbered.select("__row", "body").mapInArrow(_hashes_of, "__row long, key long").join(counts, "key")
    mine = found.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("own"))
    return numbered.join(mine, "__row", "left").select("doc_id", "body", F.col("own.key").alias("keys"), F.col("own.n").alias("counts"))
