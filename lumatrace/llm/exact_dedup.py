"""Exact duplicates through cuckoo-filter indexes of live text digests beside their contents, one index for each shard."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumatrace.llm.common import keep_by_id, materialize, utf8

#: Digests, and bytes of packed content, that a task's own index keeps live; beyond either its oldest ones are deleted.
LOCAL_KEYS, LOCAL_BYTES = 200_000, 32 << 20
#: Rows, and bytes of text, that one shard is planned for.
SHARD_ROWS, SHARD_BYTES = 250_000, 64 << 20

_CODEC = pa.Codec("zstd", compression_level=1)


def _packed(text: bytes) -> bytes:
    return len(text).to_bytes(8, "big") + _CODEC.compress(text, asbytes=True)


def _unpacked(content: bytes) -> bytes:
    return _CODEC.decompress(content[8:], int.from_bytes(content[:8], "big"), asbytes=True)


def _same(a: bytes, b: bytes) -> bool:
    """Whether two packed contents are one text, even if two versions of the codec packed them."""
    return a == b or (a[:8] == b[:8] and _unpacked(a) == _unpacked(b))


class CuckooIndex:
    """A cuckoo filter of 16-bit fingerprints over live digests, with each one's key and content bucketed beside it.

    A lookup reads two buckets; a fingerprint hit is verified against the key and the content stored in that slot (where
    both have one). A text that shares its digest with a different live text gets a key of its own from its content. When
    an insertion finds no place after MOST_KICKS moves, the filter doubles and is filled again from the stored keys.
    """

    SLOTS, MOST_KICKS = 4, 200

    def __init__(self, buckets: int = 64):
        self.keys: list[bytes | None] = []
        self.contents: list[bytes | None] = []
        self.free: list[int] = []
        self.shared = False
        self._lay_out(buckets)

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _lay_out(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = [0] * (buckets * self.SLOTS)
        self.refs = [-1] * (buckets * self.SLOTS)

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "big") or 1
        first = int.from_bytes(key[10:18], "big") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & self.mask)

    def _at(self, key: bytes) -> int:
        mark, a, b = self._places(key)
        for bucket in (a, b):
            for s in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if self.prints[s] == mark and self.keys[self.refs[s]] == key:
                    return s
        return -1

    def _slot(self, digest: bytes, content: bytes | None) -> tuple[int, bytes]:
        """The slot of a live text, or -1, and the key under which it is or would be kept."""
        s = self._at(digest)
        held = self.contents[self.refs[s]] if s >= 0 else None
        if s >= 0 and (content is None or held is None or _same(held, content)):
            return s, digest
        if content is None or (s < 0 and not self.shared):
            return -1, digest
        own = hashlib.blake2b(_unpacked(content), key=digest[:64], digest_size=32).digest()
        t = self._at(own)
        return t, own if t >= 0 or s >= 0 else digest

    def find(self, digest: bytes, content: bytes | None = None) -> int:
        """The number of a live text, or -1."""
        s, _ = self._slot(digest, content)
        return self.refs[s] if s >= 0 else -1

    def insert(self, digest: bytes, content: bytes | None = None) -> int:
        """Add a text unless it is live; its number either way."""
        s, key = self._slot(digest, content)
        if s >= 0:
            return self.refs[s]
        self.shared |= key != digest
        if self.free:
            ref = self.free.pop()
            self.keys[ref], self.contents[ref] = key, content
        else:
            ref = len(self.keys)
            self.keys.append(key)
            self.contents.append(content)
        if not self._place(ref):
            self._resize()
        return ref

    def delete(self, digest: bytes, content: bytes | None = None) -> int:
        """Remove a live text; the number it had, or -1."""
        s, _ = self._slot(digest, content)
        if s < 0:
            return -1
        ref, self.prints[s], self.refs[s] = self.refs[s], 0, -1
        self.keys[ref] = self.contents[ref] = None
        self.free.append(ref)
        return ref

    def _place(self, ref: int) -> bool:
        mark, a, b = self._places(self.keys[ref])
        for bucket in (a, b):
            for s in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if not self.prints[s]:
                    self.prints[s], self.refs[s] = mark, ref
                    return True
        bucket = b
        for kick in range(self.MOST_KICKS):
            s = bucket * self.SLOTS + kick % self.SLOTS
            self.prints[s], mark = mark, self.prints[s]
            self.refs[s], ref = ref, self.refs[s]
            bucket = self._other(bucket, mark)
            for t in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if not self.prints[t]:
                    self.prints[t], self.refs[t] = mark, ref
                    return True
        return False

    def _resize(self) -> None:
        buckets = 2 * (self.mask + 1)
        while True:
            self._lay_out(buckets)
            if all(self._place(i) for i, key in enumerate(self.keys) if key is not None):
                return
            buckets *= 2


_GROUP = "digest binary, mark long, content binary, keep_id long, n long"
_GROUP_ARROW = pa.schema([("digest", pa.binary()), ("mark", pa.int64()), ("content", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])


class _Groups:
    """Largest id and row count of each live text, by the index's numbers, the longest unused first."""

    def __init__(self):
        self.index, self.live, self.bytes = CuckooIndex(), {}, 0

    def add(self, digest: bytes, mark: int, content: bytes, doc: int | None, n: int) -> None:
        ref = self.index.insert(digest, content)
        row = self.live.pop(ref, None)
        if row is None:
            row = [digest, mark, content, doc, n]
            self.bytes += len(content)
        else:
            row[4] += n
            if doc is not None and (row[3] is None or doc > row[3]):
                row[3] = doc
        self.live[ref] = row

    def shrink(self, keys: int, size: int) -> list[list]:
        """Delete what was longest not seen from the index, until at most that many keys and bytes are live; the deleted."""
        gone = []
        while self.live and (len(self.live) > keys or self.bytes > size):
            row = self.live.pop(next(iter(self.live)))
            self.index.delete(row[0], row[2])
            self.bytes -= len(row[2])
            gone.append(row)
        return gone


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_GROUP_ARROW)], schema=_GROUP_ARROW)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups = _Groups()
    for batch in batches:
        gone = []
        for digest, mark, doc, text in zip(*(batch.column(c) for c in ("digest", "mark", "doc_id", "content")), strict=True):
            groups.add(digest.as_py(), mark.as_py(), _packed(text.as_py()), doc.as_py(), 1)
            if len(groups.live) > LOCAL_KEYS or groups.bytes > LOCAL_BYTES:
                gone += groups.shrink(LOCAL_KEYS // 2, LOCAL_BYTES // 2)
                if sum(len(r[2]) for r in gone) > LOCAL_BYTES:
                    yield _batch(gone)
                    gone = []
        if gone:
            yield _batch(gone)
    yield _batch(list(groups.live.values()))


def _rows(part: pa.Table) -> Iterator[tuple]:
    for batch in part.select(_GROUP_ARROW.names).to_batches(max_chunksize=1000):
        yield from zip(*(batch.column(c).to_pylist() for c in _GROUP_ARROW.names), strict=True)


def _merge(part: pa.Table) -> pa.Table:
    groups = _Groups()
    for row in _rows(part):
        groups.add(*row)
    return pa.Table.from_batches([_batch([[*r[:2], None, *r[3:]] for r in groups.live.values()])])


def _sharded(df: DataFrame, rows: int, size: int) -> DataFrame:
    shards = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARD_ROWS), -(-size // SHARD_BYTES))
    return df.withColumn("shard", F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % shards)


def _size(df: DataFrame) -> tuple[int, int]:
    n = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    return n.rows, n.bytes


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def digests(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, digest and mark (a second, 64-bit hash) of each whole text's UTF-8, and these bytes; null counts as empty."""
    return docs.select("doc_id", digest(utf8("text")).alias("digest"), F.xxhash64(utf8("text")).alias("mark"), utf8("text").alias("content"))


def _folded(hashed: DataFrame) -> DataFrame:
    return hashed.select("doc_id", "digest", "mark", "content").mapInArrow(_local, _GROUP)


def groups_of(hashed: DataFrame, rows: int, size: int) -> DataFrame:
    """(doc_id, digest, mark, content), so many rows and bytes -> one row (digest, mark, keep_id, n) for each distinct text.

    Each task first folds its own rows in a local index that holds a bounded number of live texts: a text that a third
    of all rows repeat stays live and reaches its shard as one row a task, others leave by deletion once many newer ones
    came. Contents are packed, and bucketed by shard of the digest; there they meet in an index of the shard's own.
    """
    return _sharded(_folded(hashed), rows, size).groupBy("shard").applyInArrow(lambda t: _merge(t), _GROUP).drop("content")


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    docs needs doc_id (distinct) and text; other columns are ignored. Texts are equal when identical, which is decided by
    their contents; null counts as empty. The largest doc_id of a group stays. Rows without doc_id count in group_size,
    but are kept only where their whole group has no doc_id (keep_id is then null). Rows that repeat the kept doc_id and
    its text are all kept. A text of any length is compared whole, within one row's memory. An empty table gives no rows.
    digest: 18 bytes or more of a text's bytes; text_sha256 shows it.
    """
    texts = digests(docs, digest)
    hashed = materialize(texts.select("doc_id", "digest", "mark", F.octet_length("content").cast("long").alias("n_bytes")), "digests")
    rows, size = _size(hashed)
    found = materialize(groups_of(texts, rows, size), "groups")
    key = ["digest", "mark"]
    hot = found.filter(F.col("n") > max(10_000, rows // 1000))  # at most 1000 texts can be this frequent
    seen = hashed.join(F.broadcast(hot.select(*key, F.col("keep_id").alias("hot_id"), F.col("n").alias("hot_n"))), key, "left")
    rest = seen.filter("hot_n is null").select("doc_id", *key).join(found, key)
    out = seen.filter("hot_n is not null").select("doc_id", "digest", F.col("hot_id").alias("keep_id"), F.col("hot_n").alias("n")).unionByName(rest.select("doc_id", "digest", "keep_id", "n"))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_last_copies(docs: DataFrame) -> DataFrame:
    """docs without the copies that exact_duplicates() does not keep; columns unchanged."""
    gone = exact_duplicates(docs).filter("not kept and doc_id is not null").select("doc_id")
    return keep_by_id(docs, materialize(gone, "gone"), "left_anti")


def update_index(index: DataFrame | None, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """A stored index (digest, mark, content, keep_id, n) after insertion of `added` and deletion of `removed` (both as digests() gives them).

    A text stays live while more rows were inserted than deleted. Index, insertions and deletions meet shard by shard, where
    contents decide what is equal; deletions leave the filter at once and free their slots.
    """
    parts = [] if index is None else [index.select(*_GROUP_ARROW.names)]
    if added is not None:
        parts.append(_folded(added))
    if removed is not None:
        parts.append(_folded(removed).withColumn("keep_id", F.lit(None).cast("long")).withColumn("n", -F.col("n")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)

    def settle(part: pa.Table) -> pa.Table:
        groups = _Groups()
        for row in _rows(part):
            groups.add(*row)
        for ref in [ref for ref, row in groups.live.items() if row[4] <= 0]:
            row = groups.live.pop(ref)
            groups.index.delete(row[0], row[2])
        return pa.Table.from_batches([_batch(list(groups.live.values()))])

    whole = materialize(whole, "index-changes")
    return _sharded(whole, *_size(whole.withColumn("n_bytes", F.octet_length("content").cast("long")))).groupBy("shard").applyInArrow(settle, _GROUP)
