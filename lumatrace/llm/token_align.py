"""Two tokenizers' tokens of the same texts laid beside each other: overlaps, common cuts, and how often two ids meet in a corpus."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatrace.llm.common import in_chunks, materialize, utf8

#: Pieces of text that a worker remembers, characters encoded by one call, pairs whose counts are sent to every task.
MOST_PIECES, SLAB, HOT_PAIRS = 600_000, 1 << 17, 1_000_000
#: Distinct pairs that a task gathers before it passes their counts on.
TASK_PAIRS = 2_000_000

# White space as Unicode has it: without the separators 0x1C to 0x1F, which Python counts in. Pieces start with a space,
# tab or line feed after something that is no white space.
_PLAIN = re.compile(r"[ \t\n]\s*(?:\S+(?:[^\S \t\n]\s*\S+)*(?:[^\S \t\n]\s*)?)?")
_EXACT = re.compile(_PLAIN.pattern.replace(r"\s", r"[^\S\x1c-\x1f]").replace(r"[^\S \t\n]", r"[^\S\x1c-\x1f \t\n]").replace(r"\S+", r"[\S\x1c-\x1f]+"))
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_STARTS, _MARK = re.compile(r"[ \t\n]"), "▁"


def pieces_of(text: str) -> list[str]:
    """A text that starts with a space, cut before white space. Neither tokenizer has a token across the place between two pieces."""
    return (_EXACT if _SEPARATORS.search(text) else _PLAIN).findall(text)


def _byte_table() -> dict[str, int]:
    """Characters of the byte-level alphabet -> byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Ragged:
    """Ids of all remembered pieces, one after another."""

    def __init__(self):
        self.flat, self.n, self.at = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def extend(self, ids: list[np.ndarray], n: list[np.ndarray]) -> None:
        self.flat, self.n = np.concatenate([self.flat, *ids]), np.concatenate([self.n, *n])
        self.at = np.cumsum(self.n) - self.n

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given pieces in order, and how many each has."""
        n = self.n[rows]
        return self.flat[np.repeat(self.at[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class Tokenizers:
    """Both libraries, bytes of each token, and the tokens of pieces seen before."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte, vocabulary = _byte_table(), self.a.get_vocab(with_added_tokens=True)
        added = {t["content"] for t in json.loads(self.a.to_str())["added_tokens"]}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if token in added else bytes(byte[c] for c in token)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_MARK, " ").encode())
            # What pieces_of() rests on: no token goes on with white space after something else.
            if _STARTS.search(piece.lstrip(_MARK).replace(_MARK, " ")[1:]):
                raise ValueError(f"a token holds white space after other characters: {piece!r}")
        self.a_len, self.b_len = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.number, self.a_ids, self.b_ids, self.good = {}, _Ragged(), _Ragged(), np.empty(0, bool)

    def _encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of texts that start with a space."""
        encode = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        return [np.array(e.ids, np.int32) for e in encode(texts, add_special_tokens=False)], [np.array(x, np.int32) for x in self.b.encode([t[1:] for t in texts], num_threads=1)]

    def _one(self, piece: str) -> tuple[np.ndarray, np.ndarray, bool]:
        if _MARK in piece:  # this character never comes back: its bytes decode as a space
            return np.empty(0, np.int32), np.empty(0, np.int32), False
        (a,), (b,) = self._encode([" x" + piece])  # the second library adds no space to an empty text
        a, b = (i[int(np.searchsorted(np.cumsum(n[i]), 2)) + 1 :] for n, i in ((self.a_len, a), (self.b_len, b)))
        body = piece.encode()
        return a, b, b"".join(map(self.a_bytes.__getitem__, a.tolist())) == body and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == body

    def _slab(self, pieces: list[str]) -> None:
        """Pieces encoded as one text, cut where they end; one by one if that text's bytes do not come back."""
        bodies = [p.encode() for p in pieces]
        body, got = b" x" + b"".join(bodies), []
        ends = np.cumsum([2, *map(len, bodies)])
        for ids, table, size in zip(self._encode([body.decode()]), (self.a_bytes, self.b_bytes), (self.a_len, self.b_len), strict=True):
            cuts = np.cumsum(size[ids[0]])
            at = np.searchsorted(cuts, ends)
            if b"".join(map(table.__getitem__, ids[0].tolist())) != body or (cuts[np.minimum(at, len(cuts) - 1)] != ends).any():
                return self._singly(pieces)
            got.append((ids[0][at[0] + 1 :], np.diff(at)))
        self.a_ids.extend([got[0][0]], [got[0][1]])
        self.b_ids.extend([got[1][0]], [got[1][1]])
        self._number(pieces, np.ones(len(pieces), bool))

    def _singly(self, pieces: list[str]) -> None:
        if pieces:
            got = [self._one(p) for p in pieces]
            for side, ids in ((self.a_ids, [g[0] for g in got]), (self.b_ids, [g[1] for g in got])):
                side.extend(ids, [np.array(list(map(len, ids)), np.int64)])
            self._number(pieces, np.array([g[2] for g in got]))

    def _number(self, pieces: list[str], good: np.ndarray) -> None:
        self.number.update(zip(pieces, range(len(self.number), len(self.number) + len(pieces)), strict=True))
        self.good = np.concatenate([self.good, good])

    def learn(self, pieces: Iterable[str]) -> None:
        found = set(pieces)
        new = found.difference(self.number)
        if len(self.number) + len(new) > MOST_PIECES and self.number:
            self.forget()
            new = found
        odd = [p for p in new if _MARK in p or p[-1].isspace()]
        plain, size, start = sorted(new.difference(odd)), 0, 0
        for i, p in enumerate(plain):
            size += len(p)
            if size >= SLAB or i + 1 == len(plain):
                self._slab(plain[start : i + 1])
                start, size = i + 1, 0
        self._singly(sorted(odd))


#: One pair of tokenizers a Python worker.
_KEPT: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _KEPT:
        _KEPT.clear()
        _KEPT[a_path, b_path] = Tokenizers(a_path, b_path)
    return _KEPT[a_path, b_path]


def _group_starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


class Alignment:
    """Tokens of a batch of texts on one axis of bytes, joined document by document.

    a, b: ids; a_doc, b_doc: the text of each; a_at, b_at: first byte; links: numbers of overlapping tokens (left, right).
    """

    def __init__(self, known: Tokenizers, texts: list[str | None]):
        cut = [pieces_of(" " + t) if t else [] for t in texts]
        known.learn(chain.from_iterable(cut))
        n = np.fromiter(map(len, cut), np.int64, len(cut))
        rows = np.fromiter(map(known.number.__getitem__, chain.from_iterable(cut)), np.int64, int(n.sum()))
        doc = np.repeat(np.arange(len(texts)), n)
        bad = np.zeros(len(texts), bool)
        bad[doc[~known.good[rows]]] = True
        rows, doc = rows[~bad[doc]], doc[~bad[doc]]
        self.docs = len(texts)
        self.a, own = known.a_ids.take(rows)
        self.a_doc = np.repeat(doc, own)
        self.b, own = known.b_ids.take(rows)
        self.b_doc = np.repeat(doc, own)
        self.a_end, self.b_end = np.cumsum(known.a_len[self.a]), np.cumsum(known.b_len[self.b])
        self.a_at, self.b_at = self.a_end - known.a_len[self.a], self.b_end - known.b_len[self.b]
        left = pd.DataFrame({"at": self.a_at, "doc": self.a_doc, "i": np.arange(len(self.a))})
        right = pd.DataFrame({"at": self.b_at, "doc": self.b_doc, "j": np.arange(len(self.b))})
        # The token of the other side that covers each token's first byte; tokens that start together are found twice.
        over = pd.merge_asof(left, right, on="at", by="doc")["j"].to_numpy().astype(np.int64)
        under = pd.merge_asof(right, left, on="at", by="doc")["i"].to_numpy().astype(np.int64)
        later = np.flatnonzero(self.a_at[under] != self.b_at) if len(under) else under
        self.left, self.right = np.concatenate([np.arange(len(self.a)), under[later]]), np.concatenate([over, later])
        # Common ends close groups.
        where = np.minimum(np.searchsorted(self.b_end, self.a_end), max(0, len(self.b) - 1))
        self.a_last = self.b_end[where] == self.a_end if len(self.b) else np.zeros(0, bool)
        self.b_last = np.zeros(len(self.b), bool)
        self.b_last[where[self.a_last]] = True

    def per_doc(self, doc: np.ndarray, weight=None) -> np.ndarray:
        return np.bincount(doc, weight, self.docs).astype(np.int64)

    def group_texts(self) -> list[str]:
        """Of each text, its groups as `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        a_group, b_group = (np.cumsum(x) - x for x in (self.a_last, self.b_last))
        groups = int(self.a_last.sum())
        a_n, b_n = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + _group_starts(b_n)[a_group]] = _texts(self.a, self.a_last, "|")
        out[np.arange(len(self.b)) + _group_starts(a_n)[b_group + 1]] = _texts(self.b, self.b_last, ";")
        ends = np.cumsum(self.per_doc(self.a_doc) + self.per_doc(self.b_doc))
        return ["".join(out[s:e].tolist())[:-1] for s, e in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]


_WORDS: dict[str, np.ndarray] = {}


def _texts(ids: np.ndarray, last: np.ndarray, closing: str) -> np.ndarray:
    """Decimal ids, each with a comma behind or, where it is the last of its kind in a group, the closing character."""
    most = int(ids.max(initial=0)) + 1
    for mark in (",", closing):
        if len(_WORDS.get(mark, ())) < most:
            _WORDS[mark] = np.array([f"{i}{mark}" for i in range(most)], object)
    out = _WORDS[","][ids]
    out[last] = _WORDS[closing][ids[last]]
    return out


def _decoded(body: bytes | None) -> str | None:
    try:
        return body.decode() if body else None
    except UnicodeDecodeError:
        return None


def align_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each row of docs: doc_id, a_ids, b_ids, group_a, group_b, link_a, link_b (arrays of int).

    a_path: a byte-level .json file, applied to a space and the text; b_path: a .model file, which adds that space itself.
    group_a[k] and group_b[k] say how many tokens of either side the k-th group holds: groups end where both sides have a
    token's end. (link_a[k], link_b[k]) are places, from 0, of two tokens whose bytes overlap. A text that is null, empty,
    not valid UTF-8, or that either side's tokens do not give back byte by byte, has empty arrays. Tokens never reach across
    the start of white space, so tokens of such pieces are looked up in a bounded memory; a text of any length is one row.
    docs needs doc_id and text; other columns are ignored; null and repeated ids and repeated rows are passed on. An empty
    table gives no rows.
    """
    names = ["a_ids", "b_ids", "group_a", "group_b", "link_a", "link_b"]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.list_(pa.int32())) for c in names)])

    def lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(_group_starts(n), pa.int32()), pa.array(values, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _tokenizers(a_path, b_path)
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            for start, stop in in_chunks(bodies):
                x = Alignment(known, [_decoded(b) for b in bodies[start:stop]])
                n_a, n_b = x.per_doc(x.a_doc), x.per_doc(x.b_doc)
                doc = x.a_doc[x.left]
                order = np.lexsort((x.right, x.left))
                firsts = [np.cumsum(n) - n for n in (n_a, n_b)]
                groups = x.per_doc(x.a_doc, x.a_last)
                cols = [lists(x.a, n_a), lists(x.b, n_b)]
                cols += [lists(np.diff(np.flatnonzero(last), prepend=-1), groups) for last in (x.a_last, x.b_last)]
                cols += [lists((side - first[doc])[order], x.per_doc(doc)) for side, first in ((x.left, firsts[0]), (x.right, firsts[1]))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), *cols], schema=schema)

    return docs.select("doc_id", utf8("text").alias("body")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} array<int>" for c in names))


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_DOC_SCHEMA = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def _digest_pass(a_path: str, b_path: str):
    """Of each text its counts, the digest of its groups, and its distinct id pairs: rising, as gaps, with how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _tokenizers(a_path, b_path)
        wide = len(known.a_bytes)
        kind = np.uint32 if wide * len(known.b_bytes) < 1 << 32 else np.uint64
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            for start, stop in in_chunks(bodies):
                x = Alignment(known, [_decoded(b) for b in bodies[start:stop]])
                doc, key = x.a_doc[x.left], x.b[x.right].astype(np.int64) * wide + x.a[x.left]
                links = x.per_doc(doc)
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.empty(0, np.int64)
                times = np.diff(np.append(first, len(key))).astype(np.uint32)
                doc, key = doc[first], key[first]
                at = _group_starts(np.bincount(doc, minlength=x.docs))
                rows = [(np.diff(key[s:e], prepend=0).astype(kind).tobytes(), times[s:e].tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
                sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.group_texts()]
                out = [batch.column("doc_id").slice(start, stop - start), x.per_doc(x.a_doc), x.per_doc(x.b_doc), x.per_doc(x.a_doc, x.a_last), links, sha, [r[0] for r in rows], [r[1] for r in rows]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, _DOC_SCHEMA, strict=True)], schema=_DOC_SCHEMA)

    return run


def _pairs_of(batch: pa.RecordBatch, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and count of all pairs of a batch."""
    keys = [np.cumsum(np.frombuffer(p, kind).astype(np.int64)) for p in batch.column("pairs").to_pylist()]
    times = np.frombuffer(b"".join(batch.column("times").to_pylist()), np.uint32).astype(np.int64)
    return np.repeat(np.arange(len(keys)), list(map(len, keys))), np.concatenate([*keys, np.empty(0, np.int64)]), times


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _count_pass(kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, more = np.empty(0, np.int64), np.empty(0, np.int64), []
        for batch in batches:
            more.append(_pairs_of(batch, kind)[1:])
            if sum(len(m[0]) for m in more) > TASK_PAIRS:
                keys, n = _summed(np.concatenate([keys, *(m[0] for m in more)]), np.concatenate([n, *(m[1] for m in more)]))
                more = []
                if len(keys) > TASK_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])
                    keys, n = keys[:0], n[:0]
        keys, n = _summed(np.concatenate([keys, *(m[0] for m in more)]), np.concatenate([n, *(m[1] for m in more)]))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    return run


def _hot(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs and their counts, HOT_PAIRS at most, in rising order of pair."""
    bands = counts.groupBy(F.floor(F.log2("n") * 8).cast("long").alias("band")).agg(F.count("*").alias("m"), F.min("n").alias("least")).collect()
    least, room = None, HOT_PAIRS
    for r in sorted(bands, key=lambda r: -r.band):
        room -= r.m
        if room < 0:
            break
        least = r.least
    if least is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    own = counts.filter(F.col("n") >= int(least)).select("pair", "n").toArrow().sort_by("pair")
    return own["pair"].to_numpy(), own["n"].to_numpy()


_SUM = "row long, n_best long, count_sum long, cold array<struct<pair:long,times:long>>"
_COLD = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))


def _sum_pass(sent, kind, wide: int):
    """Sums over the pairs whose counts were sent; the others go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            row, key, times = _pairs_of(batch, kind)
            at = np.minimum(np.searchsorted(pair, key), max(0, len(pair) - 1))
            hot = pair[at] == key if len(pair) else np.zeros(len(key), bool)
            count = np.zeros(len(key), np.int64)
            count[hot] = n[at[hot]]
            top = hot & (count == best[key // wide])
            total, high = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            np.add.at(total, row, count * times)
            np.add.at(high, row[top], times[top])
            cold = pa.ListArray.from_arrays(pa.array(_group_starts(np.bincount(row[~hot], minlength=len(batch))), pa.int32()), pa.StructArray.from_arrays([pa.array(key[~hot]), pa.array(times[~hot])], ["pair", "times"]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(high), pa.array(total), cold], names=["row", "n_best", "count_sum", "cold"])

    return run


def alignment_digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Tokens, groups and links are those of align_texts(). An id pair's count is how many links of the whole corpus join the
    two ids. count_sum adds up the counts over a text's links; n_best counts the links whose pair has the highest count of
    all pairs with the same second id. groups_sha256: of `a1,a2|b1;a3|b2,b3`, '' without tokens. Cases as for align_texts().

    Each text's distinct pairs are written once; tasks add up counts before they shuffle them. The most frequent pairs'
    counts (HOT_PAIRS at most) and each second id's highest count (as many as that vocabulary has ids) are sent to all
    tasks; pairs beyond them, each of them rare, are joined by shuffle.
    """
    spark = docs.sparkSession
    known = Tokenizers(a_path, b_path)
    wide, others = len(known.a_bytes), len(known.b_bytes)
    kind = np.uint32 if wide * others < 1 << 32 else np.uint64
    del known
    own = docs.select("doc_id", utf8("text").alias("body")).mapInArrow(_digest_pass(a_path, b_path), _DOC)
    texts = materialize(own.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counted = texts.select("pairs", "times").mapInArrow(_count_pass(kind), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counted, "pairs")
    second = F.floor(F.col("pair") / F.lit(wide)).cast("long")
    highest = counts.groupBy(second.alias("b")).agg(F.max("n").alias("best"))
    best = np.zeros(others, np.int64)
    for r in highest.collect():  # as many rows as the second vocabulary has ids, at most
        best[r.b] = r.best
    sent = spark.sparkContext.broadcast((*_hot(counts), best))
    sums = materialize(texts.select("row", "pairs", "times").mapInArrow(_sum_pass(sent, kind, wide), _SUM), "sums")
    rare = sums.select("row", F.explode("cold").alias("c")).select("row", "c.pair", "c.times")
    found = rare.join(counts.withColumn("b", second), "pair").join(F.broadcast(highest), "b")
    late = found.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("late_sum"), F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("late_best"))
    whole = texts.drop("pairs", "times").join(sums.drop("cold"), "row").join(late, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "late_best"), plus("count_sum", "late_sum"), "groups_sha256")
