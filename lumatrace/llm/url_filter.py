"""URL filtering: fixed rules first, then naive Bayes over the words that host names and paths are made of."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatrace.llm.common import materialize

# Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Parts of a host name that mark it as an example of block, one by itself, or everyday ones of which it takes two.
SEED_WORDS = tuple("adult porn sex xxx nude escort casino poker slots gambling viagra cialis spam malware phishing warez torrent keygen clickbait".split())
EVERYDAY_SEEDS = tuple("ads bet bets betting cheap click crack farm free jackpot loan loans lottery payday pharmacy pills popup replica track tracker tracking win".split())

#: Rounds in which hosts without marks are weighed anew by what the last weights make of them.
ROUNDS = 2
LONGEST_WORD = 20


def host_and_path(url: str = "url") -> tuple[F.Column, F.Column]:
    """Host: after the first "://" up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def rule_of(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits, and its verdict; both null where none does."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        which, verdict = F.when(fits, h + p).otherwise(which), F.when(fits, said).otherwise(verdict)
    return which, verdict


def _best_split(labels: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unigram Viterbi over the candidate words of each label; letters that no word covers cost a fixed amount each."""
    for batch in labels:
        out = []
        for label, words in zip(batch.column("label").to_pylist(), batch.column("words").to_pylist(), strict=True):
            known = {w["word"]: w["cost"] for w in words or []}
            best = [(0.0, 0)] + [(math.inf, 0)] * len(label)
            for j in range(1, len(label) + 1):
                best[j] = min((best[i][0] + known.get(label[i:j], 14.0 * (j - i)), i) for i in range(max(0, j - LONGEST_WORD), j) if j - i == 1 or label[i:j] in known)
            cut, j = [], len(label)
            while j:
                i = best[j][1]
                cut.append(label[i:j])
                j = i
            out.append(cut[::-1])
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.list_(pa.string()))], names=["label", "words"])


def segment(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label), (word, n) -> (label, words): each label's most probable split under the unigram counts.

    The words that a label might hold are found by a join on its substrings, so the word table is never broadcast.
    """
    total = words.agg(F.sum("n")).first()[0] or 1
    cost = words.select("word", (F.log(F.lit(float(total)) + 1) - F.log("n")).alias("cost"))
    parts = labels.select("label", F.explode(F.expr(f"flatten(transform(sequence(1, length(label)), i -> transform(sequence(1, least({LONGEST_WORD}, length(label) - i + 1)), k -> substring(label, i, k))))")).alias("word")).distinct()
    found = parts.join(cost, "word").groupBy("label").agg(F.collect_list(F.struct("word", "cost")).alias("words"))  # bounded by a label's substrings
    return labels.join(found, "label", "left").select("label", "words").mapInArrow(_best_split, "label string, words array<string>")


def _pieces(text: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _separated(host: str = "host") -> F.Column:
    return F.split(host, r"[.\-_:]")


def _words(words: tuple[str, ...]) -> F.Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def _marks(hosts: DataFrame, split: DataFrame, seeds: tuple[str, ...], everyday: tuple[str, ...]) -> DataFrame:
    """(host, marked): the parts that `.`, `-`, `_` and `:` separate hold a seed, or two different everyday ones, or one of
    the parts is made of two or more seeds of either kind and nothing else. A seed inside a longer word marks nothing."""
    parts = F.array_distinct(_separated())
    apart = (F.size(F.array_intersect(parts, _words(seeds))) >= 1) | (F.size(F.array_intersect(parts, _words(everyday))) >= 2)
    made = split.filter((F.size("words") >= 2) & (F.size(F.array_except("words", _words(seeds + everyday))) == 0)).select("label")
    joined = hosts.select("host", F.explode(_separated()).alias("label")).join(made, "label", "left_semi").select("host").distinct().withColumn("made", F.lit(True))
    return hosts.join(joined, "host", "left").select("host", (apart | F.coalesce("made", F.lit(False))).alias("marked"))


def _weigh(tokens: DataFrame, classes: DataFrame) -> tuple[DataFrame, float]:
    """Multinomial naive Bayes: (word, w), the log of how much likelier a word is under block, add-one smoothed; and the prior's."""
    seen = materialize(tokens.join(classes, "host").groupBy("word").agg(F.sum("bad").alias("b"), F.sum(1 - F.col("bad")).alias("a")), "token_counts")
    total_b, total_a, v = seen.agg(F.coalesce(F.sum("b"), F.lit(0.0)), F.coalesce(F.sum("a"), F.lit(0.0)), F.count("*")).first()
    n_bad, n_all = classes.agg(F.coalesce(F.sum("bad"), F.lit(0.0)), F.count("*")).first()
    prior = math.log((n_bad + 1) / (n_all - n_bad + 1)) if n_all else -1.0
    return seen.select("word", (F.log((F.col("b") + 1) / F.lit(total_b + v + 1.0)) - F.log((F.col("a") + 1) / F.lit(total_a + v + 1.0))).alias("w")), prior


def judge_urls(pages: DataFrame, rules=RULES, seeds: tuple[str, ...] = SEED_WORDS, everyday: tuple[str, ...] = EVERYDAY_SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, score, host_words.

    Where no rule fits, the verdict is block if multinomial naive Bayes finds that likelier (score > 0), else allow.
    Words: every label of a host is split by unigram Viterbi, with counts from the pages' own visible text and from host
    names in which `-`, `_` and `.` already part the words; seeds are words of their own that count at least once.
    Learning: hosts whose separated parts hold one of `seeds` or two of `everyday`, or a part made of seeds alone, are
    examples of block, all others of allow to begin with; each host's words and the words of its
    distinct paths are counted by class, add-one smoothed. In each of `rounds` further passes the hosts without marks count
    for block by the probability that the last weights give their names (expectation and maximisation). Only columns
    page_id, url and html (if there) are read; null or odd urls have an empty host and path, no words, the prior's score,
    and are allowed. Numbers, words of one or two ASCII letters and a few parts of any host name don't count. Repeated
    rows are judged alike, very long urls are read whole, and an empty table gives no rows.
    """
    host, path = host_and_path()
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = materialize(base.select("host", "path").distinct(), "urls")
    hosts = urls.select("host").distinct().filter("host != ''")
    labels = hosts.select(F.explode(_separated()).alias("label")).filter("label != ''").distinct()
    texts = [urls.select(F.explode(_pieces(F.col("path"))).alias("word")), hosts.filter(F.col("host").contains("-")).select(F.explode(_separated()).alias("word"))]
    if "html" in pages.columns:
        texts.append(pages.select(F.explode(_pieces(F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>|&[a-z]+;", " "))).alias("word")))
    words = texts[0]
    for t in texts[1:]:
        words = words.union(t)
    counts = words.filter(f"length(word) between 2 and {LONGEST_WORD} and not word rlike '[0-9]'").groupBy("word").agg(F.count("*").alias("n"))
    known = counts.union(pages.sparkSession.createDataFrame([(w, 1) for w in seeds + everyday], "word string, n long")).groupBy("word").agg(F.max("n").alias("n"))
    split = materialize(segment(labels, materialize(known, "words")), "split")

    own = hosts.select("host", F.explode(_separated()).alias("label")).join(split, "label").select("host", F.explode("words").alias("word"))
    own = materialize(own, "host_words")
    shared = ["www", "m", "blog", "com", "org", "net"]  # parts of names that say nothing about content
    telling = ((F.length("word") >= 3) | F.col("word").rlike(r"[^\x00-\x7F]")) & ~F.col("word").isin(shared)  # short ASCII ones are languages and the like
    own_said = own.filter(telling)
    said = urls.select("host", "path", F.explode(_pieces(F.col("path"))).alias("word")).filter(telling & ~F.col("word").rlike("^[0-9]+$"))
    tokens = materialize(own_said.union(said.select("host", "word")), "tokens")
    marks = materialize(_marks(hosts, split, seeds, everyday), "marks")
    classes = marks.select("host", F.col("marked").cast("double").alias("bad"))
    weight, prior = _weigh(tokens, classes)
    for _ in range(rounds):
        odds = own_said.join(weight, "word").groupBy("host").agg(F.sum("w").alias("w"))
        chance = 1 / (1 + F.exp(-(F.lit(prior) + F.coalesce("w", F.lit(0.0)))))
        classes = materialize(marks.join(odds, "host", "left").select("host", F.when(F.col("marked"), 1.0).otherwise(F.round(chance, 9)).alias("bad")), "classes")
        weight, prior = _weigh(tokens, classes)
    by_host = own_said.join(weight, "word").groupBy("host").agg(F.sum("w").alias("host_score"))
    names = own.groupBy("host").agg(F.array_sort(F.collect_set("word")).alias("host_words"))
    by_path = said.join(weight, "word").groupBy("host", "path").agg(F.sum("w").alias("path_score"))
    scored = urls.join(by_host, "host", "left").join(names, "host", "left").join(by_path, ["host", "path"], "left")
    scored = scored.select("host", "path", "host_words", F.round(F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0)), 6).alias("score"))
    which, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = base.join(scored, ["host", "path"], "left")
    return out.select("page_id", "host", "path", which.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score", "host_words")
