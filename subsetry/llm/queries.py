"""The queries of the training-data operators and their SQL, for the driver's contract."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfiles import round_trip

    return round_trip(_read(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return score(docs, labels, keep=["doc_id"])


def op5_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunk_bpe import encode_decode

    return encode_decode(_read(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(_read(spark, sf_dir, "documents")).drop("found")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import scan

    return scan(_read(spark, sf_dir, "documents")).drop("found")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_read(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import duplicate_groups

    return duplicate_groups(_read(spark, sf_dir, "documents"))


def op10_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lz_fingerprint import compare

    return compare(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_token_files, op3_simhash, op4_toxicity, op5_chunked_bpe, op6_secret_scan, op7_pii, op8_warc, op9_exact_dedup, op10_lz_fingerprint)}

_LOWERED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

_BITS = "(unhex(sha1(coalesce(html, '')))::BIT)::VARCHAR"
_DIGIT = " + ".join(f"{2 ** (4 - k)} * substr(bits, 5 * i::INT + {k + 1}, 1)::INT" for k in range(5))

ORACLES = {
    "op8_warc": f"""
        SELECT page_id, octet_length(encode(h)) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('{string.ascii_uppercase}234567', 1 + {_DIGIT}, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS h, {_BITS} AS bits, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)""",
    "op9_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOWERED} AS t FROM documents)
        WINDOW w AS (PARTITION BY t)""",
}
