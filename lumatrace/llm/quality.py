"""Text quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatrace.llm.common import keep_by_id, materialize, utf8

#: Hashed byte pairs, byte classes' pairs and lengths that describe a text.
TERMS, CLASSES = 2048, 8
WIDTH = TERMS + CLASSES * CLASSES * CLASSES + 24
#: Term weights are mostly zeros: the sample travels packed.
_CODEC = pa.Codec("zstd", compression_level=1)
#: Classes of bytes: lower, upper, digit, space, line end, full stop and comma, other punctuation, beyond ASCII.
_CLASS = np.array([7 if b > 127 else 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b == 32 else 4 if b in (10, 13) else 5 if b in (44, 46) else 6 for b in range(256)], np.int64)


def terms(text: bytes) -> np.ndarray:
    """Term weights of one whole text: log-damped frequencies of hashed byte pairs, of class triples, and its size and repetition."""
    out = np.zeros(WIDTH)
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw), 1 << 20):  # in blocks, each with the two bytes after it, so that memory stays bounded
        block = raw[at : at + (1 << 20) + 2].astype(np.int64)
        own = min(len(block), 1 << 20)
        pair = (block[:-1] * 257 + block[1:]) * 2654435761 >> 8
        out[:TERMS] += np.bincount((pair % TERMS)[:own], minlength=TERMS)
        c = _CLASS[block]
        triple = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
        out[TERMS : TERMS + CLASSES**3] += np.bincount(triple[:own], minlength=CLASSES**3)
    n = max(1, len(raw))
    out[: TERMS + CLASSES**3] = np.log1p(1000 * out[: TERMS + CLASSES**3] / n)
    tail = out[TERMS + CLASSES**3 :]
    tail[min(11, len(raw).bit_length() // 2)] = 3.0
    lines, words = text.split(b"\n"), text.split()
    tail[12] = 4 * (1 - len(set(lines)) / len(lines))
    tail[13] = 4 * (1 - len(set(words)) / max(1, len(words)))
    return out


class LatentModel:
    """Mean and leading right singular vectors of the sample's term weights; vectors are unit length (zero if undefined).

    The fit centres and scales the given weights in place, so that the sample is held once.
    """

    def __init__(self, weights: np.ndarray, rank: int):
        self.mean = weights.mean(axis=0) if len(weights) else np.zeros(WIDTH)
        self.idf = 1 / (0.05 + np.concatenate([weights[:, i : i + 256].std(axis=0) for i in range(0, WIDTH, 256)])) if len(weights) else np.ones(WIDTH)
        x = weights
        x -= self.mean
        x *= self.idf
        # Randomised subspace iteration with a fixed seed: the leading axes without a full decomposition.
        basis = np.linalg.qr(np.random.default_rng(7).standard_normal((WIDTH, min(rank + 16, WIDTH))))[0]
        for _ in range(6):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        _, s, v = np.linalg.svd(x @ basis, full_matrices=False)
        self.axes = basis @ v[:rank][s[:rank] > 1e-9].T

    def vectors(self, weights: np.ndarray) -> np.ndarray:
        return self.project((weights - self.mean) * self.idf)

    def project(self, scaled: np.ndarray) -> np.ndarray:
        x = scaled @ self.axes
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 1e-12)


def vote(vectors: np.ndarray, known: np.ndarray, labels: np.ndarray, neighbours: int, prior: float) -> np.ndarray:
    """For each vector, its nearest labelled vectors' labels weighted by a power of the similarity. Exact cosines, in one block.

    Each label's votes count by its share among all learnable rows (prior) over its share among the known ones.
    """
    if not len(known):
        return np.full(len(vectors), prior)
    cosine = vectors @ known.T
    k = min(neighbours, len(known))
    at = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    own = labels.mean()
    each = np.where(labels == 1, prior / max(own, 1e-9), (1 - prior) / max(1 - own, 1e-9))
    w = np.maximum(np.take_along_axis(cosine, at, axis=1), 0) ** 4 * each[at]
    return ((w * labels[at]).sum(axis=1) + 0.01 * prior) / (w.sum(axis=1) + 0.01)


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = pa.array([_CODEC.compress(terms(t.as_py()).astype(np.float32).tobytes(), asbytes=True) for t in batch.column("body")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("quality"), w], names=["quality", "weights"])


def _unpacked(weights: bytes) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(weights, 4 * WIDTH, asbytes=True), np.float32)


def _fit(read: pa.Table, rank: int) -> tuple[LatentModel, np.ndarray, np.ndarray]:
    """The sample's packed rows -> the model, their vectors and labels. Rows stay packed beside the one matrix they fill."""
    packed, marks = read.column("weights").to_pylist(), np.array(read.column("quality").to_pylist(), float)
    lead = np.array([_unpacked(w)[:8] for w in packed], np.float32).reshape(-1, 8)
    order = np.lexsort((marks, *lead.T))
    weights = np.empty((len(packed), WIDTH))
    for i, at in enumerate(order):
        weights[i] = _unpacked(packed[at])
    model = LatentModel(weights, rank)
    return model, model.project(weights), marks[order]


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, rank: int = 48, neighbours: int = 15, threshold: float = 0.7) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0).

    docs needs doc_id and text, labels doc_id and quality (0 or 1); other columns are ignored. Labels are learned from a
    fixed sample of at most `sample_rows` labelled rows that are not held out, those with the smallest hash of their id
    (half of them from the rarer label where there are that many), so what is gathered and broadcast is bounded by
    that parameter. Rows whose label or doc_id is null are not learned from. Null texts count as empty, and empty texts
    are scored like others. Without any labels every score is 0.5. Repeated rows get equal scores. A text's score
    depends on its bytes alone.
    """
    own = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    sample = own.filter("quality = 0").orderBy(order).limit(sample_rows // 2).union(own.filter("quality = 1").orderBy(order).limit(sample_rows // 2))
    sample = docs.sparkSession.createDataFrame(sample.collect(), sample.schema)  # bounded by sample_rows
    texts = docs.filter("doc_id is not null").select("doc_id", utf8("text").alias("body"))
    read = texts.join(F.broadcast(sample), "doc_id").select("quality", "body").mapInArrow(_weights, "quality int, weights binary").distinct()
    model, known, marks = _fit(read.toArrow(), rank)
    share = own.agg(F.avg("quality")).first()[0]
    prior = 0.5 if share is None else float(share)
    sent = docs.sparkSession.sparkContext.broadcast((model, known, marks, prior))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, marks, prior = sent.value
        for batch in batches:
            scores = np.empty(len(batch))
            body = batch.column("body")
            for i in range(0, len(batch), 256):
                x = model.vectors(np.stack([terms(t.as_py()) for t in body[i : i + 256]]))
                scores[i : i + 256] = vote(x, known, marks, neighbours, prior)
            scores = np.clip(np.round(scores, 12), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], schema=schema)

    return docs.select("doc_id", held_out().alias("held_out"), utf8("text").alias("body")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without those that score_quality() rejects; columns unchanged. Rows without doc_id stay."""
    rejected = score_quality(docs, labels, **options).filter("predicted = 0 and doc_id is not null").select("doc_id")
    return keep_by_id(docs, materialize(rejected, "rejected"), "left_anti")
