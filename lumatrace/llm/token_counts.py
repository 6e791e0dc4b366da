"""Token counts of texts, with a shortcut for words that are proven to be one token."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lumatrace.llm.common import PairTable, in_chunks, merge_pairs, splitter, utf8


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


#: A word's entry is its number of tokens, plus this if the shortcut counted it.
_WHOLE = 1 << 40


class Counter(dict):
    """word -> entry. Counts tokens of a byte-level BPE file (.json): merges, added tokens, and the words proven whole."""

    #: Remembered words; forgotten beyond this, so that memory stays bounded.
    MOST = 400_000

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = _byte_letters(), spec["model"]
        raw = lambda s: bytes(letters[c] for c in s)
        self.vocabulary = {raw(s): i for s, i in model["vocab"].items() if all(c in letters for c in s)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.order = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        # Merges by numbers: bytes are 0 to 255, and what the i-th merge makes is the number of its string.
        number = {bytes([b]): b for b in range(256)}
        self.made = [number.setdefault(a + b, 256 + i) for i, (a, b) in enumerate(self.order)]
        self.ranks = {number[a] << 20 | number[b]: i for i, (a, b) in enumerate(self.order)}
        self.table = PairTable(list(range(256)), self.ranks, self.made)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.whole = self.prove() if whole is None else whole
        self._start()

    def _start(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.whole, 1 + _WHOLE))

    def merge(self, word: bytes) -> int:
        """The number of tokens that the merges leave of a word."""
        return len(merge_pairs(list(word), self.ranks, self.made))

    def merge_long(self, word: bytes) -> int:
        """As merge(), pass by pass: each pass joins the best pair wherever it occurs, for words of many bytes."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            seen = {p for p in zip(parts, parts[1:], strict=False) if p in self.order}
            if not seen:
                return len(parts)
            a, b = min(seen, key=self.order.__getitem__)
            out, i = [], 0
            while i < len(parts):
                if parts[i] == a and i + 1 < len(parts) and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out

    def prove(self) -> frozenset[str]:
        """The vocabulary's strings that its merges turn into that one token; each is merged once, before any text is read."""
        out = []
        for token in self.vocabulary:
            if self.merge(token) == 1:
                try:
                    out.append(token.decode())
                except UnicodeDecodeError:
                    continue
        return frozenset(out)

    def learn(self, words: set[str]) -> None:
        """Merge the words that are new and short together."""
        if len(self) >= self.MOST:
            self._start()
        new = sorted((b for w in words if w not in self and len(b := w.encode()) <= PairTable.LONGEST), key=len)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.update(zip((b.decode() for b in part), self.table.merge(part)[1].tolist(), strict=True))

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self._start()
        b = word.encode()
        n = self[word] = self.merge(b) if len(b) <= 256 else self.merge_long(b)
        return n

    def count(self, words: list[str]) -> tuple[int, int]:
        """(tokens, those that the shortcut counted)."""
        direct, all_but = divmod(sum(map(self.__getitem__, words)), _WHOLE)
        return all_but, direct


#: One counter a vocabulary file and Python worker: tasks that a worker runs one after another share what it has learned.
_KEPT: dict[str, Counter] = {}


def _counter(path: str, whole: frozenset[str]) -> Counter:
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Counter(path, whole)
    return _KEPT[path]


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 1024) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_whole.

    n_whole is how many tokens the shortcut counted. docs needs doc_id and text; other columns are ignored, and a null
    doc_id is passed on. Null counts as empty: 0 bytes, 0 tokens. An added token's string inside a text is one token,
    as the file's library has it by default. The proof runs once, on the driver; what is sent to the tasks is part of the
    vocabulary, so its size is bounded by the file's.
    """
    whole = docs.sparkSession.sparkContext.broadcast(Counter(path).whole)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_whole", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, split = _counter(path, whole.value), splitter(pattern)
        for batch in batches:
            bodies, rows = batch.column("body").to_pylist(), []
            for start, stop in in_chunks(bodies):
                cut = []
                for body in bodies[start:stop]:
                    segments = [body.decode()]
                    for special in counter.added:
                        segments = [p for s in segments for p in s.split(special)]
                    cut.append([split(s) for s in segments])
                counter.learn({w for segments in cut for words in segments for w in words})
                for body, segments in zip(bodies[start:stop], cut, strict=True):
                    n, direct = len(segments) - 1, 0
                    for words in segments:
                        tokens, shortcut = counter.count(words)
                        n, direct = n + tokens, direct + shortcut
                    rows.append((len(body), n, n > limit, direct))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(4))], schema=schema)

    return docs.select("doc_id", utf8("text").alias("body")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long")
