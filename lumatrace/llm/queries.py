"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from lumatrace.llm.bpe import round_trip
from lumatrace.llm.common import table
from lumatrace.llm.embed_dedup import embedding_duplicates
from lumatrace.llm.exact_dedup import exact_duplicates
from lumatrace.llm.lm_score import score_corpus
from lumatrace.llm.minhash import near_duplicates
from lumatrace.llm.packing import pack
from lumatrace.llm.pii import surrogate_text
from lumatrace.llm.quality import score_quality
from lumatrace.llm.secret_scan import BASE, TOKENS, secret_digests
from lumatrace.llm.token_align import alignment_digests
from lumatrace.llm.token_counts import count_tokens
from lumatrace.llm.url_filter import judge_urls
from lumatrace.llm.whitening import whiten

#: Stands in for a secret that a real run reads from its own key store.
PII_KEY = b"example key: replace in production"


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs every document by its token count, as op2 has it."""
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pack(counted.select("doc_id", "n_tokens"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its surrogates in place: doc_id, text, n_entities, changed."""
    return surrogate_text(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, count="n_entities", changed="changed")


def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op11_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=8)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def _secret_sql() -> str:
    """Places of matches are lengths of what lies before: the parts between matches, and the matches themselves."""
    rules = [(i, rule) for i, rule in enumerate((*BASE.rules, *TOKENS.rules))]
    parts = []
    for i, rule in rules:
        pattern = rule.pattern.replace("[0-9a-f]+", "[0-9a-f]{16,}").replace("'", "''")  # short runs of hex digits hide no others
        parts.append(f"""SELECT r, {i} AS k, '{rule.kind}' AS kind, m, list_transform(s, lambda x: length(x)) AS gaps, {rule.least} AS least, list_transform(m, lambda x: length(regexp_extract(x, '{pattern}', {rule.group}))) AS sizes
            FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS s FROM d) WHERE len(m) > 0""")
    told = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k)"
    return f"""
            WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), hit AS ({' UNION ALL '.join(parts)}),
            each AS (SELECT r, k, kind, gaps, m, sizes, least, unnest(range(1, len(m) + 1)) AS i FROM hit),
            span AS (SELECT r, k, kind, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n FROM each WHERE sizes[i] >= least),
            f AS (SELECT r, k, kind, a, a + n AS b FROM span),
            doc AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
                    coalesce({told} FILTER (k < {len(BASE.rules)}), '') AS base, {told} AS spans FROM f GROUP BY r)
            SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
            FROM d LEFT JOIN doc USING (r)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_round_trip, op2_token_counts, op3_best_fit_packing, op4_exact_dedup, op5_lm_scores, op6_url_filter, op7_embedding_near_dedup, op8_pii_surrogates, op9_quality_votes, op10_minhash_near_dedup, op11_secret_ledger, op12_embedding_whitening, op13_tokenizer_alignment)}


def oracle_sql() -> dict[str, str]:
    return {
        "op11_secret_ledger": _secret_sql(),
        "op4_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
        "op7_embedding_near_dedup": """
            WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
            good AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
            link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
            reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
            part AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
            SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN part ON part.a = vec_id LEFT JOIN n ON n.a = vec_id""",
        "op10_minhash_near_dedup": """
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: w[i : i + 2])) AS sh FROM w WHERE len(w) > 0),
            k AS (SELECT doc_id, hash(sh) AS h, sh FROM s), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM k x JOIN k y ON x.h = y.h AND x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL),
            link AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
            reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
            part AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
            SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id, w.doc_id = c AS kept FROM w JOIN part ON part.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id""",
    }
