"""The ten operators as queries over whole tables: thin wrappers that derive the columns asked for."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, langid, lm_scoring, matroska, packing, pii, piece_codec, simhash, topk, toxicity, warc


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file: in the folder NOTEWRIGHT_TOKENIZERS, if it is set, else where the package has it."""
    folder = os.environ.get("NOTEWRIGHT_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark, sf_dir):
    return lm_scoring.score_documents(_read(spark, sf_dir, "documents"))


def op2_sentencepiece(spark, sf_dir):
    return piece_codec.encode(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_topk(spark, sf_dir):
    return topk.search(_read(spark, sf_dir, "embeddings"))


def op4_toxicity(spark, sf_dir):
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_pii(spark, sf_dir):
    return pii.pseudonymise(_read(spark, sf_dir, "documents"), pii.secret_key())


def op7_matroska(spark, sf_dir):
    return matroska.media_features(_read(spark, sf_dir, "documents"))


def op8_packing(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_langid(spark, sf_dir):
    return langid.identify(_read(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    path = common.fresh_path(spark, "warc-archive")
    warc.write_archive(_read(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_lm_scoring, op2_sentencepiece, op3_topk, op4_toxicity, op5_simhash, op6_pii, op7_matroska, op8_packing, op9_langid, op10_warc, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express; it has no XXH64, tokenizers, models and media containers."""
    return {
        "op10_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
            d AS (
              SELECT page_id, octet_length(encode(payload)) AS n, CAST(CAST(unhex(sha1(payload)) AS BIT) AS VARCHAR) AS bits,
                min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
              list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
                + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER)
                + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER)
                + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS BIGINT), 1)), lambda a, b: a || b) AS payload_digest,
              CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
            FROM d""",
        "op3_topk": """
            WITH v AS (
              SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
              WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
              SELECT a.place, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
            SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 20""",
    }
