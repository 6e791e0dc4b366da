"""Personal data and secrets: detection, and keyed surrogates of the same type, script and format."""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
import sys
import unicodedata
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatrace.llm.common import materialize

# Given names by script and gender, and the titles that come before names. Surrogates stay in their list.
NAMES = {
    ("latin", "f"): "Anna Alice Carmen Chloe Claire Diana Elena Emily Emma Greta Hanna Helen Ines Irene Julia Laura Lea Lucia Maria Marta Mary Monika Nina Olivia Paula Rosa Sara Sofia Sophie Ursula".split(),
    ("latin", "m"): "Adam Alan Bruno Carlos David Diego Erik Felix Frank Georg Hans Henri Hugo Ivan James Javier John Jonas Jules Karl Lars Louis Lukas Manuel Marco Oscar Pablo Paul Peter Tomas".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Лидия Мария Нина Ольга Софья".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Иван Кирилл Максим Олег Павел Роман".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Señora Madame Mme Sra".split(), "m": "Mr Herr Señor Monsieur Sr".split(), "": "Dr Prof".split()}

#: Originals whose surrogates are made anew after an audit, and passes over the texts, at most.
MOST_FAULTS, MOST_PASSES = 10_000, 3

#: Kind -> pattern; where two overlap the earlier kind wins. A group named v marks the part that is replaced.
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<v>[A-Z0-9]{16})(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9_])(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|pk_live_|npm_|hf_|AIza)(?P<v>[A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])",
    "jwt": r"(?<![A-Za-z0-9_.-])(?P<v>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-])",
    "secret": r"(?i:(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)(?P<v>[A-Za-z0-9_\-./+]{8,})",
    "email": r"(?<![\w.+-])(?P<v>[\w.+-]+@(?:[\w-]+\.)+[^\W\d_]{2,})(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])(?P<v>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "card": r"(?<![\w.])(?P<v>[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3})(?![\w])",
    "ssn": r"(?<![\w-])(?P<v>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])",
    "phone": r"(?<![\w.])(?P<v>\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|(?<![-/])[2-9][0-9]{2}(?P<gap>[-. ])[0-9]{3}(?P=gap)[0-9]{4}(?!-)|(?<![-/])0[1-9](?P<two>[-. ]?)[0-9]{2}(?P=two)[0-9]{2}(?P=two)[0-9]{2}(?P=two)[0-9]{2}(?!-)|(?<![-/])0[0-9]{2,4}[ /-][0-9]{5,8}(?!-))(?![\w])",
    "ipv4": r"(?<![\w.])(?P<v>(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9]))(?![\w]|\.[0-9])",
    "ipv6": r"(?<![\w:.])(?P<v>(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]|\.[0-9])",
    "name": r"(?<!\w)(?:" + "|".join(t for ts in TITLES.values() for t in sorted(ts, key=len, reverse=True)) + r")\.? (?P<v>{0}(?: {0})?)(?!\w)".replace("{0}", r"[^\W\d_a-zа-я](?:[^\W\d_]|[-'’](?=[^\W\d_]))+"),
}
_FINDERS = [(kind, re.compile(p)) for kind, p in PATTERNS.items()]
#: A text without any of these holds nothing that the patterns find.
_TRIGGER = re.compile(r"[0-9@]|PRIVATE KEY|eyJ|(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk[-_]|_live_|npm_|hf_|AIza)|(?i:password|passwd|pwd|secret|token|key)|\b(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\b")


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every entity, in order, without overlaps; kind mention: a name found elsewhere in the text; part: the
    rest of an entity that another one overlaps."""
    if not _TRIGGER.search(text):
        return []
    taken: list[tuple[int, int, str]] = []
    for kind, finder in _FINDERS:
        for m in finder.finditer(text):
            a, b = m.span("v") if "v" in finder.groupindex else m.span()
            if kind == "card" and text[a:b].isdigit() and not _checks(text[a:b]):
                continue  # sixteen digits in a row that no card can have
            over = sorted((x, y) for x, y, _ in taken if x < b and a < y)
            if not over:
                taken.append((a, b, kind))
                continue
            for x, y in [*over, (b, b)]:  # what an earlier kind leaves of this find is replaced by itself
                if a < x and any(c.isalnum() for c in text[a:x]):
                    taken.append((a, x, "part"))
                a = max(a, y)
    for value in _mentions(text, taken):
        for m in re.finditer(rf"(?<!\w){re.escape(value)}(?!\w)", text):
            if all(m.end() <= x or m.start() >= y for x, y, _ in taken):
                taken.append((*m.span(), "mention"))
    return sorted(taken)


def _check_digit(body: str) -> int:
    """The digit that makes a card number of `body` valid."""
    return (sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body))) * 9) % 10


def _checks(digits: str) -> bool:
    return _check_digit(digits[:-1]) == int(digits[-1])


def _mentions(text: str, taken: list[tuple[int, int, str]]) -> list[str]:
    """Names found after titles, and their parts of two letters or more, longest first: what a bare mention may look like."""
    names = {text[a:b] for a, b, kind in taken if kind == "name"}
    parts = {p for n in names for p in re.split("[ -]", n) if len(p) > 1} | {p for n in names for p in n.split(" ") if len(p) > 1}
    return sorted(names | parts, key=lambda v: (-len(v), v))


_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "ÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"]
#: Secrets of lower-case hex digits stay such; in IPv6 addresses digits and the letters a to f keep apart.
_HEX_OF = dict.fromkeys("0123456789abcdef", "0123456789abcdef")
_GROUP_OF = {c: a for a in ("abcdef", "ABCDEF") for c in a}
_OF = {c: a for a in _ALPHABETS for c in a}
#: Names keep vowels and consonants apart, so that they stay speakable.
_NAME_OF = {c: a for a in ("aeiou", "AEIOU", "bcdfghjklmnpqrstvwxyz", "BCDFGHJKLMNPQRSTVWXYZ") for c in a}
#: Common letters of further scripts and languages, so that surrogates of usual words are made of usual letters.
_COMMON = [
    "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩΆΈΉΊΌΎΏΪΫ", "ąćęłńśźżčďěňřšťůžğışőűășțāēģīķļņūėįųľĺŕđðþøæœß", "ĄĆĘŁŃŚŹŻČĎĚŇŘŠŤŮŽĞİŞŐŰĂȘȚĀĒĢĪĶĻŅŪĖĮŲĽĹŔĐÐÞØÆŒẞŸ", "ёіїєґў", "ЁІЇЄҐЎ",
    "ابتثجحخدذرزسشصضطظعغفقكلمنهويءآأؤإئةى", "אבגדהוזחטיכךלמםנןסעפףצץקרשת", "".join(map(chr, range(0x4E00, 0x9FA6))), "".join(map(chr, range(0xAC00, 0xD7A4))), "".join(map(chr, range(0x3041, 0x3097))), "".join(map(chr, range(0x30A1, 0x30FB))),
]
_OF |= {c: a for a in _COMMON for c in a}


@functools.cache
def _rest() -> dict[str, str]:
    """Every other letter or number of Unicode -> all of its script (first word of its name) and category; loners pooled."""
    groups: dict[tuple[str, str], list[str]] = {}
    for c in map(chr, range(sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        if kind[0] in "LN" and c not in _OF:
            groups.setdefault((unicodedata.name(c, kind).split()[0], kind), []).append(c)
    pooled: dict[str, list[str]] = {}
    for (_, kind), members in [g for g in groups.items() if len(g[1]) == 1]:
        pooled.setdefault(kind[0], []).extend(members)
    lists = [m for m in groups.values() if len(m) > 1] + list(pooled.values())
    return {c: a for a in map("".join, lists) for c in a}


def _alphabet(c: str) -> str | None:
    """The closed alphabet in which a letter or number is replaced; None for other characters."""
    return _OF.get(c) or (_rest().get(c) if ord(c) > 127 and unicodedata.category(c)[0] in "LN" else None)


_SHAPES = {a: str(i) for i, a in enumerate(_ALPHABETS)} | {"0123456789abcdef": "h", "abcdef": "f", "ABCDEF": "F"}
_LISTED = {n: names for names in NAMES.values() for n in names}


class Surrogates:
    """Keyed permutations: within one kind and format, different originals always get different surrogates."""

    def __init__(self, key: bytes, again: int = 0):
        """again: how often an original's surrogate has been found at fault; each time has permutations of its own."""
        self.key, self.again = key, f"~{again}" if again else ""

    def _stream(self, label: str, width: int) -> int:
        """`width` keyed pseudo-random bytes as a number: as many as a half needs, however long the value is."""
        seed = hmac.new(self.key, label.encode(), hashlib.sha256).digest()
        return int.from_bytes(seed if width <= 32 else hashlib.shake_256(seed).digest(width), "big")

    def permute(self, number: int, size: int, label: str) -> int:
        """A keyed bijection of range(size): a Feistel network over a square that holds it, walked until back inside."""
        if size <= 1:
            return 0
        side = max(2, int(size**0.5) if size < 1 << 52 else 1 << (size.bit_length() + 1) // 2)
        while side * side < size:
            side += 1
        width = side.bit_length() // 8 + 9  # 64 bits more than a half has, so that the remainder is even to 2^-64
        while True:
            a, b = divmod(number, side)
            for i in range(6):
                a, b = b, (a + self._stream(f"{label}/{size:x}/{i}/{b:x}", width)) % side
            number = a * side + b
            if number < size:
                return number

    def shaped(self, value: str, label: str) -> str:
        """Every letter and digit is replaced within its own alphabet; everything else, and the length, stays."""
        own = {"hex": _HEX_OF, "ipv6": _GROUP_OF, "name": _NAME_OF}.get(label.split("~")[0], {})
        alphabets = [own.get(c) or _alphabet(c) for c in value]
        n, size = 0, 1
        for c, a in zip(value, alphabets, strict=True):
            if a:
                n, size = n * len(a) + a.index(c), size * len(a)
        shape = "".join("." if not a else _SHAPES.get(a) or f"[{a[0]}]" for a in alphabets)
        n = self._moved(n, size, f"{label}{self.again}:{shape}")
        out = []
        for c, a in zip(reversed(value), reversed(alphabets), strict=True):
            if a:
                n, k = divmod(n, len(a))
                c = a[k]
            out.append(c)
        return "".join(reversed(out))

    def _moved(self, n: int, size: int, label: str) -> int:
        """permute(), composed with a shift of its one fixed orbit: never the original where there is a choice."""
        if size <= 1:
            return n
        if size % 2 and n in (0, size - 1):  # the last of an odd number has no neighbour: if fixed, it changes places with 0
            last = self.permute(size - 1, size, label)
            if last == size - 1:
                return last if n == 0 else self._paired(0, size, label)
        return self._paired(n, size, label)

    def _paired(self, n: int, size: int, label: str) -> int:
        got = self.permute(n, size, label)
        # A fixed point takes the image of its cyclic successor among the fixed points' images: here, its own image is
        # swapped with that of its neighbour n ^ 1, which keeps the map a bijection.
        pair = n ^ 1
        if pair >= size:
            return got
        other = self.permute(pair, size, label)
        return other if got == n or other == pair else got

    def card(self, digits: str) -> str:
        """The issuer's first digit stays; a valid check digit stays valid, an invalid one invalid."""
        step = (int(digits[-1]) - _check_digit(digits[:-1])) % 10
        new = digits[0] + self.shaped(digits[1:-1], f"card{digits[0]}{step}")
        return new + str((_check_digit(new) + step) % 10)

    def name(self, value: str) -> str:
        """Each part by itself, so that a part alone gets the same surrogate: listed names in their list, others outside all lists."""
        return "".join(part if part in (" ", "-") else self._part(part) for part in re.split("([ -])", value))

    def ipv4(self, value: str) -> str:
        """Octets with zeros before them keep their width and theirs: addresses of one spelling are moved among themselves."""
        octets = value.split(".")
        if all(str(int(o)) == o for o in octets):
            n = self._moved(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, "ipv4" + self.again)
            return ".".join(map(str, n.to_bytes(4, "big")))
        # Two digits after a zero, one digit after a zero, or any plain octet.
        sizes = [256 if str(int(o)) == o else 10 ** (len(o) - 1) for o in octets]
        n = functools.reduce(lambda n, x: n * x[0] + int(x[1]), zip(sizes, octets, strict=True), 0)
        shape = ".".join(str(len(o)) if size < 256 else "0" for o, size in zip(octets, sizes, strict=True))
        n, out = self._moved(n, functools.reduce(lambda a, b: a * b, sizes), f"ipv4/{shape}{self.again}"), []
        for o, size in zip(reversed(octets), reversed(sizes), strict=True):
            n, k = divmod(n, size)
            out.append(str(k) if size == 256 else str(k).zfill(len(o)))
        return ".".join(reversed(out))

    def outside_hex(self, value: str, label: str) -> str:
        """Mixed secrets are walked on until they don't look like one of lower-case hex digits, whose surrogates stay such."""
        out = self.shaped(value, label)
        while re.fullmatch(r"[0-9a-f]+", out):
            out = self.shaped(out, label)
        return out

    def _part(self, part: str) -> str:
        if part in _LISTED:
            names = _LISTED[part]
            return names[self._moved(names.index(part), len(names), "name" + names[0] + self.again)]
        out = self.shaped(part, "name")
        while out in _LISTED:  # walked on until outside the lists, which keeps the map a bijection
            out = self.shaped(out, "name")
        return out

    def of(self, kind: str, value: str) -> str:
        """The surrogate of a found value."""
        if kind == "email":
            user, _, host = value.partition("@")
            return f"{self.shaped(user, 'email@' + host.lower())}@{host}"
        if kind == "ipv4":
            return self.ipv4(value)
        if kind == "card":
            new = iter(self.card(re.sub(r"\D", "", value)))
            return "".join(next(new) if c.isdigit() else c for c in value)
        if kind == "phone":
            keep = re.match(r"\+[0-9]{1,3}(?=[ .-])|", value).end()
            return value[:keep] + self.shaped(value[keep:], "phone" + value[:keep])
        if kind in ("name", "mention"):
            return self.name(value)
        if kind == "private_key":
            head, foot = value.index("\n") if "\n" in value else value.index("-----", 5) + 5, value.rindex("-----END")
            return value[:head] + self.shaped(value[head:foot], kind) + value[foot:]
        if kind == "secret":
            return self.shaped(value, "hex") if re.fullmatch(r"[0-9a-f]+", value) else self.outside_hex(value, kind)
        if kind == "jwt":  # the first letters of head and body say what it is: they stay
            return ".".join(p[:3] + self.shaped(p[3:], f"jwt{i}") if i < 2 else self.shaped(p, "jwt2") for i, p in enumerate(value.split(".")))
        return self.shaped(value, kind)


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("original", pa.string()), ("surrogate", pa.string())]))


def _replace(names: list[str], column: str, key: bytes, again: dict[tuple[str, str], int]):
    """Rows with their texts replaced, the entities found (count, distinct triples) and whether the text differs.

    again: (kind, original) -> which set of permutations it takes instead of the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {k: Surrogates(key, k) for k in {0, *again.values()}}
        for batch in batches:
            texts, counts, changed, entities = [], [], [], []
            for text in batch.column(column):
                body = text.as_py()
                found = find(body) if body else []
                out, at, own = [], 0, set()
                for a, b, kind in found:
                    named = "name" if kind == "mention" else kind
                    new = sets[again.get((named, body[a:b]), 0)].of(kind, body[a:b])
                    own.add((named, body[a:b], new))
                    out += [body[at:a], new]
                    at = b
                texts.append("".join([*out, body[at:]]) if found else body)
                counts.append(sum(kind not in ("mention", "part") for _, _, kind in found))
                changed.append(texts[-1] != body)
                entities.append([dict(zip(("kind", "original", "surrogate"), e, strict=True)) for e in sorted(own)])
            columns = [pa.array(texts, pa.string()) if n == column else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(changed, pa.bool_()), pa.array(entities, _FOUND)], names=[*names, "__found", "__changed", "__entities"])

    return run


def _replaced(docs: DataFrame, key: bytes, column: str, again: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """docs with columns c0, c1, ..., their text replaced, and __found, __changed, __entities."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(inner, docs.schema.fields, strict=True))
    added = "__found long, __changed boolean, __entities array<struct<kind: string, original: string, surrogate: string>>"
    return docs.toDF(*inner).mapInArrow(_replace(inner, inner[docs.columns.index(column)], key, again or {}), f"{kinds}, {added}")


def _distinct(replaced: DataFrame) -> DataFrame:
    return replaced.select(F.explode("__entities").alias("e")).select("e.kind", "e.original", "e.surrogate").distinct()


def entities(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """The distinct (kind, original, surrogate) of a corpus."""
    return _distinct(_replaced(docs.select(column), key, column))


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for more than one original of their kind, or for themselves, or that break coreference."""
    shared = found.groupBy("kind", "surrogate").agg(F.countDistinct("original").alias("n")).filter("n > 1").select("kind", "surrogate", F.lit("shared").alias("fault"))
    # What is replaced of an e-mail address is the user, of a key its body; without a letter or number there is no choice.
    open_part = F.when(F.col("kind") == "email", F.substring_index("original", "@", 1)).when(F.col("kind") == "private_key", F.regexp_replace("original", "-----[A-Z ]*-----", "")).otherwise(F.col("original"))
    same = found.filter((F.col("original") == F.col("surrogate")) & open_part.rlike(r"[\p{L}\p{N}]")).select("kind", "surrogate", F.lit("unchanged").alias("fault"))
    torn = found.groupBy("kind", "original").agg(F.countDistinct("surrogate").alias("n"), F.min("surrogate").alias("surrogate")).filter("n > 1").select("kind", "surrogate", F.lit("torn").alias("fault"))
    return shared.unionByName(same).unionByName(torn)


def surrogate_text(docs: DataFrame, key: bytes, column: str = "text", count: str | None = None, check: bool = True, changed: str | None = None) -> DataFrame:
    """docs with every detected entity in `column` replaced; other columns unchanged; `count` and `changed` name added columns: entities
    that the patterns find (bare mentions of a name are not counted again), and whether the text differs.

    Null stays null and empty stays empty. Repeated rows and repeated entities get the same surrogate everywhere, as it
    depends on key and value only; a name found after a title is replaced, whole or in parts, wherever its text holds it.
    Where two finds overlap, the kind listed first in PATTERNS is replaced whole and the other one's rest
    by itself. Distinctness
    holds by construction, each kind and format being mapped by a permutation; with `check`, the replaced texts and what
    was found in them are written to the shared folder by one pass, and the distinct entities of the corpus are audited
    by two aggregations. Originals at fault (two that share a surrogate, or one left as it was) take other permutations in
    another pass, MOST_FAULTS at most and MOST_PASSES times; what faults are left then is warned of, never raised: texts
    are replaced all the same. Nothing is gathered but such originals.
    """
    out, again = _replaced(docs, key, column), {}
    for turn in range(1, MOST_PASSES + 1 if check else 1):
        out = materialize(out, "surrogates")
        every = _distinct(out)
        faults = collisions(every)
        if faults.isEmpty():
            break
        at_fault = every.join(faults.select("kind", "surrogate").distinct(), ["kind", "surrogate"], "left_semi").select("kind", "original").distinct().limit(MOST_FAULTS).collect()
        if turn == MOST_PASSES:
            warnings.warn(f"surrogates of {len(at_fault)} originals or more are not distinct", stacklevel=2)
            break
        again |= {(r.kind, r.original): turn for r in at_fault}
        out = _replaced(docs, key, column, again)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return out.select(*kept, *([F.col("__found").alias(count)] if count else []), *([F.col("__changed").alias(changed)] if changed else []))
