"""Byte-level BPE encoding and decoding by monoid tree reduction."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumatrace.llm.common import PairTable, in_chunks, merge_pairs, splitter, utf8


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of base64 token and rank pairs."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MonoidBpe:
    """Encodes pieces of text; encodings of neighbours are joined without encoding everything again.

    A sequence of tokens is the encoding of its bytes exactly when every two neighbours are: no merge then ever crosses
    a boundary, because whether one would depends on the two tokens at that boundary alone. join() therefore encodes a
    window of tokens around the seam and lets it grow until the window's outermost tokens agree with their neighbours.
    """

    #: Pieces up to this many bytes are merged directly.
    LEAF = 24
    #: Remembered pieces and pairs; both are forgotten beyond this, so that memory stays bounded.
    MOST = 400_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.agreed: dict[tuple[int, int], bool] = {}
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {ranks[t[:i]] << 20 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.same = range(len(self.vocabulary))
        self.table = PairTable(self.byte, self.pairs, self.same)

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost first among equals."""
        if len(piece) > 4 * self.LEAF:
            return self._merge_long(piece)
        return merge_pairs([self.byte[b] for b in piece], self.pairs, self.same)

    def _merge_long(self, piece: bytes) -> list[int]:
        """As merge(), with a heap over linked parts: for windows that had to grow."""
        n, get = len(piece), self.ranks.get
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] >= 0 else n
            if j >= n or end[i] < 0 or end[j] != stop:
                continue
            end[i], after[i], end[j] = end[j], after[j], -1
            if after[i] < n:
                before[after[i]] = i
                if (r := get(piece[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := get(piece[before[i] : end[i]])) is not None:
                heapq.heappush(heap, (r, before[i], end[i]))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def agree(self, a: int, b: int) -> bool:
        known = self.agreed.get((a, b))
        if known is None:
            if len(self.agreed) >= self.MOST:
                self.agreed.clear()
            known = self.agreed[a, b] = self.merge(self.vocabulary[a] + self.vocabulary[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of left and right together."""
        if not left or not right:
            return left or right
        if self.agree(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(map(self.vocabulary.__getitem__, left[-i:] + right[:j])))
            low = i == len(left) or self.agree(left[-i - 1], window[0])
            high = j == len(right) or self.agree(window[-1], right[j])
            if low and high:
                return left[:-i] + window + right[j:]
            i, j = (i if low else 2 * i), (j if high else 2 * j)

    def encode(self, piece: bytes) -> list[int]:
        if len(piece) <= self.LEAF:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.encode(piece[:half]), self.encode(piece[half:]))

    def encode_match(self, piece: bytes) -> list[int]:
        """A match of the splitting pattern: one token if the vocabulary has it whole."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.encode(piece)

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree; at the leaves, of up to 4096 tokens."""
        if len(ids) <= 4096:
            return b"".join(map(self.vocabulary.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class Pieces(dict):
    """match -> its ids as little-endian unsigned 32-bit bytes, remembered while it fits."""

    def __init__(self, bpe: MonoidBpe):
        self.bpe = bpe

    def learn(self, matches: set[str]) -> None:
        """Encode the matches that are new together: leaves of up to LEAF bytes at once, then joined up the tree."""
        if len(self) >= self.bpe.MOST:
            self.clear()
        new = [m.encode() for m in matches if m not in self]
        rest = []
        for b in new:
            if (whole := self.bpe.ranks.get(b)) is not None:
                self[b.decode()] = np.array([whole], "<u4").tobytes()
            elif len(b) <= self.bpe.LEAF:
                rest.append(b)
        rest.sort(key=len)
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            ids, size = self.bpe.table.merge(part)
            for b, row, n in zip(part, ids.astype("<u4"), size.tolist(), strict=True):
                self[b.decode()] = row[:n].tobytes()

    def __missing__(self, match: str) -> bytes:
        if len(self) >= self.bpe.MOST:
            self.clear()
        out = self[match] = np.array(self.bpe.encode_match(match.encode()), "<u4").tobytes()
        return out


#: One memory of pieces a vocabulary file and Python worker, for all tasks that the worker runs.
_KEPT: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Pieces(MonoidBpe(read_ranks(path)))
    return _KEPT[path]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), for each whole text: every match of pattern is encoded by itself; null counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, split = _pieces(path), splitter(pattern)
        for batch in batches:
            ids = [np.frombuffer(b"".join(map(pieces.__getitem__, split(t.as_py().decode()))), "<i4") for t in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], schema=schema)

    return docs.select("doc_id", utf8("text").alias("body")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes of each row's ids; null ids count as none."""
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _pieces(path).bpe
        for batch in batches:
            out = [bpe.decode(x.as_py() or []) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode each whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    docs needs doc_id and text; other columns are ignored, and a null doc_id is passed on. Null counts as empty: no ids,
    and both digests are those of no bytes. Rows are independent, so repeated rows give repeated results. Ids stay in
    the task that made them; only digests leave it.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, split = _pieces(path), splitter(pattern)
        bpe = pieces.bpe
        for batch in batches:
            bodies, rows = batch.column("body").to_pylist(), []
            for start, stop in in_chunks(bodies):
                cut = [split(b.decode()) for b in bodies[start:stop]]
                pieces.learn({m for matches in cut for m in matches})
                for matches in cut:
                    ids = b"".join(map(pieces.__getitem__, matches))
                    back = bpe.decode(np.frombuffer(ids, "<u4").tolist())
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(3))], schema=schema)

    return docs.select("doc_id", utf8("text").alias("body")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
