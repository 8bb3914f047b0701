"""The registered queries of the corpus operators, over the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, main_text, mixing, ngram_join, quality, secrets, sharding, substrings, tokenstore

END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenstore.token_files(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), END_ID)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secrets.secret_spans(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.debruijn_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.suffix_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_files, op2_decontamination, op3_ngram_join, op4_quality, op5_secrets, op6_debruijn, op7_suffix_dedup, op8_main_text, op9_mixing, op10_sharding]
    return {f.__name__: f for f in own}


_SQL_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL = {
    "op6_debruijn": f"""
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS ws FROM documents),
        g AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
        h AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM g),
        d AS (SELECT r, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
        c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM d),
        x AS (SELECT w.r, u.p, w.ws[u.p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(p)),
        k AS (SELECT x.r, count(*) AS n, string_agg(x.word, ' ' ORDER BY x.p) AS kept FROM x ANTI JOIN c ON x.r = c.r AND x.p = c.p GROUP BY x.r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k ON w.r = k.r""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
