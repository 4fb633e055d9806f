"""The queries of this subpackage: ``QUERIES`` by name, and ``ORACLE_SQL`` where DuckDB SQL can give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, embedding_dedup, jaccard_join, language_id, license_scan, line_dedup, lm_scoring, merkle, quality, resampling, token_counts, url_filters
from lodestone.llm._shared import bound_batches
from lodestone.llm.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id gives n (in no fold)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % n, F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(remainder("doc_id", 5) != 0))
    out = language_id.predict(docs.withColumn("held_out", remainder("doc_id", 5) == 0), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 7) == 2
    model, rest = lm_scoring.fit(docs.where(~held_out))
    return lm_scoring.score(docs.withColumn("held_out", held_out), model, rest, ["doc_id", "held_out"], ~F.col("held_out"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"), license_scan.known_digests(spark))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, "contaminated")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, model, F.col("source"), F.concat_ws("/", "source", "lang"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(_table(spark, sf_dir, "documents"), shingle=3, least=(90, 100))


#: Verdict, host and path of the rules.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "verdict string, host string, path string")
    return url_filters.filter_urls(_table(spark, sf_dir, "pages"), rules)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, columns = _table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(remainder("doc_id", 5) == 0, merkle.leaf_digest(*[low if c == "text" else F.col(c) for c in columns]))
    out = merkle.manifest(docs, columns, extra={"tampered": tampered}).withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    proof = F.sha2(F.array_join("path.others", ""), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_lm_scoring, op3_license_scan, op4_token_counts, op5_decontaminate, op6_quality, op7_jaccard_join, op8_url_filters, op9_byte_bpe, op10_embedding_dedup,
        op11_merkle_manifest, op12_line_dedup, op13_target_resampling,
    )
}
