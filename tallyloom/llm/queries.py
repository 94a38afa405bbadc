"""The registered queries of this subpackage, each over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, html, katz, lexical, minhash, mixing, pii, quality, runs, tokens, warc, winnow

TOKENIZER = "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), pii.session_key(spark))
    return found.select("doc_id", "text", F.aggregate(F.map_values("pii"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_replaced"), F.array_join(F.array_sort(F.map_keys("pii")), ",").alias("kinds"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(pages(spark, sf_dir))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.media(documents(spark, sf_dir)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(pages(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.planted(documents(spark, sf_dir))))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digests(winnow.contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_counts, op2_pii, op3_quality_rules, op4_lm_scoring, op5_mixing, op6_html_extraction, op7_minhash, op8_media_columns, op9_bpe, op10_warc, op11_lexical_search, op12_periodic_runs, op13_decontamination)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_warc": """
            WITH p AS (
                SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id
                FROM pages
            )
            SELECT page_id, payload_bytes, payload_digest,
                CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
            FROM p
        """,
        "op11_lexical_search": r"""
            WITH terms AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
            ), total AS (
                SELECT count_if(len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS l FROM terms
            ), tf AS (
                SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM terms) GROUP BY ALL
            ), asked AS (
                SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
            ), weights AS (
                SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs
            ), scored AS (
                SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l))))::BIGINT AS score
                FROM asked JOIN tf USING (term) JOIN weights USING (term), total GROUP BY item_id, doc_id
            ), placed AS (
                SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
            )
            SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= 10
        """,
    }
