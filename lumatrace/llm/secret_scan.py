"""Secrets in a history of texts: a ledger of contents by digest, so that each content meets each version of the rules once."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lumatrace.llm.common import materialize, shared_dir, utf8

#: Digests that a task remembers, so that copies it meets again are not sent on.
TASK_DIGESTS = 200_000


@dataclass(frozen=True)
class Rule:
    """kind, pattern, least length of `group` (0: the whole match), and a literal that a text must hold for the pattern to be tried."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    needs: str = ""


@dataclass(frozen=True)
class RuleSet:
    """Rules under a name and version; a change of any rule needs another version."""

    name: str
    version: int
    rules: tuple[Rule, ...]

    @property
    def key(self) -> str:
        return f"{self.name}-{self.version}"


# The base rules. Letters of words are ASCII alone.
BASE = RuleSet(
    "base", 1,
    (
        Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
        Rule("access", r"AKIA[A-Z0-9]+", 18, 0, "AKIA"),
        Rule("hex", r"[0-9a-f]+", 16),
    ),
)

# Published shapes of common credentials.
TOKENS = RuleSet(
    "tokens", 1,
    (
        Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
        Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0, "eyJ"),
        Rule("git", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, "gh"),
        Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, "xox"),
        Rule("bearer", r"Bearer [A-Za-z0-9._~+/-]{20,}=*", 0, 0, "Bearer "),
        Rule("userinfo", r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{3,64}@", 0, 0, "://"),
    ),
)


def _finder(rule: Rule) -> Callable[[str], list[tuple[int, int]]]:
    pattern = re.compile(rule.pattern)
    if rule.group == 0 and rule.least and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):  # runs of one class: short ones need not be visited
        pattern = re.compile(rule.pattern[:-1] + f"{{{rule.least},}}")

    def find(text: str) -> list[tuple[int, int]]:
        if rule.needs and rule.needs not in text:
            return []
        return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]

    return find


def _decoded(body: bytes | None) -> str:
    return (body or b"").decode(errors="replace")  # a replaced character is one code point and no part of a secret


_FINDING = "blob binary, rules string, spans array<struct<kind:string,at:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("at", pa.int32()), ("stop", pa.int32())]))


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents that this task has not met yet."""
    met: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, blob in enumerate(batch.column("blob").to_pylist()):
            if blob not in met:
                if len(met) >= TASK_DIGESTS:
                    met.clear()
                met.add(blob)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def _scan(rule_sets: tuple[RuleSet, ...]):
    """Each content against the rule versions that its `todo` names. Copies lie side by side: each is scanned once."""
    order = {r.key: i for i, r in enumerate(rule_sets)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = {r.key: [(rule.kind, _finder(rule)) for rule in r.rules] for r in rule_sets}
        last = None
        for batch in batches:
            rows: list[tuple[bytes, str, list[dict]]] = []
            for blob, body, todo in zip(batch.column("blob").to_pylist(), batch.column("body").to_pylist(), batch.column("todo").to_pylist(), strict=True):
                if blob == last:
                    continue
                last, text = blob, _decoded(body)
                for key in sorted(todo, key=order.__getitem__):
                    rows.append((blob, key, [{"kind": kind, "at": a, "stop": b} for kind, find in finders[key] for a, b in find(text)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], _SPANS)], names=["blob", "rules", "spans"])

    return run


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # the first scan of a ledger
        return spark.createDataFrame([], schema)


def scan_history(history: DataFrame, ledger: str, rule_sets: Iterable[RuleSet] = (BASE, TOKENS), content: str = "text") -> DataFrame:
    """Every row of history with blob (SHA-256 of its content's UTF-8) and findings; content itself is left out.

    findings: array of (rules, kind, at, stop), places in code points, stop exclusive, sorted by place, then by the rules' and
    their kinds' order. history has a row for each version of each path: any columns, one of which holds the content. Null
    content counts as empty; bytes that are not valid UTF-8 are read as U+FFFD.

    ledger is a folder that all executors share; it keeps one row for each pair of content and rule version scanned so far,
    those without findings included. Only pairs it does not hold are scanned, and added to it: a second scan of the same
    history scans nothing, a new rule version only that one. Scans of one ledger must not overlap; a scan that fails before
    it ends adds nothing. Contents are sent once a task and digest, and meet all their copies under their digest; rows of
    history meet the findings by digest alone. A content that very many rows share is joined in parts by adaptive execution.
    Repeated rows and null keys are passed on. An empty history gives no rows.
    """
    sets = tuple(rule_sets)
    spark = history.sparkSession
    hashed = history.withColumn("blob", F.unhex(F.sha2(utf8(content), 256)))
    known = _read(spark, ledger, _FINDING)
    wanted = F.array(*(F.lit(r.key) for r in sets))
    # Contents not seen with every wanted version; those seen with some carry the rest in `todo`.
    done = known.filter(F.col("rules").isin([r.key for r in sets])).groupBy("blob").agg(F.collect_set("rules").alias("done"))
    bodies = hashed.select("blob", utf8(content).alias("body")).mapInArrow(_fresh, "blob binary, body binary")
    open_ = bodies.join(done, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = open_.select("blob", "body", "todo").repartition(parts, "blob").sortWithinPartitions("blob")
    new = materialize(dealt.mapInArrow(_scan(sets), _FINDING), "scanned")
    new.write.mode("append").parquet(ledger)
    now = _read(spark, ledger, _FINDING).filter(F.col("rules").isin([r.key for r in sets]) & (F.size("spans") > 0))
    rank = F.create_map(*(x for i, r in enumerate(sets) for k, rule in enumerate(r.rules) for x in (F.lit(f"{r.key}/{rule.kind}"), F.lit(1000 * i + k))))
    one = now.select("blob", "rules", F.explode("spans").alias("s")).select("blob", F.struct(F.col("s.at").alias("at"), rank[F.concat_ws("/", "rules", "s.kind")].alias("rank"), F.col("s.stop").alias("stop"), "rules", F.col("s.kind").alias("kind")).alias("f"))
    found = one.groupBy("blob").agg(F.array_sort(F.collect_list("f")).alias("found"))
    out = hashed.drop(content).join(found, "blob", "left")
    tidy = F.transform(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), lambda f: F.struct(f["rules"].alias("rules"), f["kind"].alias("kind"), f["at"].alias("at"), f["stop"].alias("stop")))
    return out.withColumn("findings", tidy).drop("found")


def secret_digests(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Counts and base_sha256 come from the base rules (`kind:start:end`, comma-joined, sorted by start, then kind as listed);
    spans holds all findings likewise, those of the further rules after base ones that start at the same place. docs needs
    doc_id and text. Cases as for scan_history(). Without a ledger, an empty one in the shared folder is used.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", "text")
    found = scan_history(own, ledger or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", (BASE, TOKENS))
    told = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws(":", f["kind"], f["at"], f["stop"])), ",")
    base = F.filter("findings", lambda f: f["rules"] == BASE.key)
    count = lambda kind: F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("findings")).alias("spans"))
