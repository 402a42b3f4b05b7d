"""The registered queries of this subpackage: ``opN_<name>`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import alignment, ball_tree, chat_tree, dart_minhash, mixing, ngram_quality, packing, secret_scan, sharding, simhash_tree, site_quality, spelling, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_classes(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_table(spark, sf_dir, "documents"))


def op4_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op5_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op7_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tree.digest(chat_tree.with_probe(_table(spark, sf_dir, "conversations")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), keep_ids=False)


def op9_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(_table(spark, sf_dir, "embeddings"))


def op10_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_simhash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tree.near_components(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_site_quality, op2_dart_minhash, op3_substring_dedup, op4_bounded_ring, op5_weighted_mix, op6_secret_scan, op7_chat_tree, op8_packing, op9_ball_tree, op10_ngram_quality, op11_simhash_tree, op12_spelling_variants, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": substring_dedup.ORACLE_SQL, "op5_weighted_mix": mixing.ORACLE_SQL, "op9_ball_tree": ball_tree.ORACLE_SQL, "op12_spelling_variants": spelling.ORACLE_SQL}
