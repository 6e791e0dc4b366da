"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this many (8 bytes each, tens of MB once hashed) may be broadcast; beyond it a shuffled join is used.
BROADCAST_IDS = 1_000_000


def small_batches(spark: SparkSession) -> None:
    """Texts are long: batches of a thousand rows between JVM and Python, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode alone, one of our own where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it again. Survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_by_id(df: DataFrame, ids: DataFrame, how: str, column: str = "doc_id") -> DataFrame:
    """df left_semi or left_anti ids on one id column; ids are broadcast only if they are few, else shuffled."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, column, how)


def utf8(column: str) -> F.Column:
    """Text as bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


class WordHash(dict):
    """word (bytes) -> 64-bit hash, remembered for at most `most` words so that a worker's memory stays bounded."""

    def __init__(self, most: int = 400_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every window of n word hashes, in order."""
    m = len(words) - n + 1
    h = words[:m].copy()
    for i in range(1, n):
        h = mix64(h) + words[i : i + m]
    return mix64(h)


def shingle_set(text: bytes, n: int, words: WordHash) -> np.ndarray:
    """Sorted distinct n-word shingles as 64-bit hashes; fewer than n words: the whole sequence as one; none: empty."""
    split = text.lower().split()  # on bytes: lower-cases A-Z only, splits at 0x20 and 0x09-0x0D only
    if not split:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    return np.unique(ngram_hashes(w, min(n, len(w))) + np.uint64(max(0, n - len(w))))


# Letters, numbers and white space among the first 256 code points, as \p{L}, \p{N} and \s have them.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a text-splitting pattern. For the well-known one, texts of the first 256 code points take a faster equal."""
    anywhere = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return anywhere
    latin = re.compile(_LATIN).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return anywhere(text)
        return latin(text)

    return split


def merge_pairs(ids: list[int], rank_of: dict[int, int], made: list[int] | range) -> list[int]:
    """Merge neighbours, lowest rank first and leftmost among equals. rank_of: a << 20 | b -> rank; made: rank -> new id."""
    get, far = rank_of.get, 1 << 60
    ranks = [get(a << 20 | b, far) for a, b in zip(ids, ids[1:], strict=False)]
    while ranks:
        low = min(ranks)
        if low == far:
            break
        i = ranks.index(low)
        ids[i] = made[low]
        del ids[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = get(ids[i] << 20 | ids[i + 1], far)
        if i:
            ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], far)
    return ids


class PairTable:
    """Merges of many short words at once: rank and product of each mergeable pair, looked up in sorted arrays."""

    #: Longer words are merged by themselves.
    LONGEST = 40
    _NONE = np.iinfo(np.int64).max

    def __init__(self, byte: list[int], rank_of: dict[int, int], made: list[int] | range):
        keys = np.fromiter(rank_of.keys(), np.int64, len(rank_of))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(rank_of.values(), np.int64, len(rank_of))[order]
        self.byte, self.made = np.array(byte, np.int64), np.array(made, np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.ranks[at], self._NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids (a row for each word, -1 beyond its end) and lengths, for words of at most LONGEST bytes."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.full((len(words), max(1, int(size.max(initial=0)))), -1, np.int64)
        filled = np.arange(ids.shape[1])[None, :] < size[:, None]
        ids[filled] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        left, width = size.copy(), ids.shape[1]
        if width < 2:
            return ids, left
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        open_, column = np.arange(len(words)), np.arange(width)[None, :]
        while True:
            own = rank[open_]
            at = own.argmin(axis=1)
            low = own[np.arange(len(own)), at]
            go = low < self._NONE
            open_, at, low, own = open_[go], at[go], low[go], own[go]
            if not len(open_):
                return ids, left
            row = np.arange(len(open_))
            x = ids[open_]
            x[row, at] = self.made[low]
            take = column + (column > at[:, None])
            x = np.take_along_axis(np.concatenate([x, np.full((len(x), 1), -1)], axis=1), take, axis=1)
            y = np.take_along_axis(np.concatenate([own, np.full((len(own), 1), self._NONE)], axis=1), take[:, :-1] + (column[:, :-1] == at[:, None]), axis=1)
            after, before = np.minimum(at + 1, width - 1), np.maximum(at - 1, 0)
            new = np.where(at + 1 < width, self._rank(x[row, at], x[row, after]), self._NONE)
            inner = at < width - 1
            y[row[inner], at[inner]] = new[inner]
            first = at > 0
            y[row[first], before[first]] = self._rank(x[row[first], before[first]], x[row[first], at[first]])
            ids[open_], rank[open_] = x, y
            left[open_] -= 1


def in_chunks(bodies: list[bytes], most: int = 1 << 21):
    """Slices (start, stop) of texts of about `most` bytes together, at least one text each."""
    start, size = 0, 0
    for i, b in enumerate(bodies):
        size += len(b)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(bodies):
        yield start, len(bodies)
