"""Queries opN_<name> of the training-data operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_in_middle, filter_audit, hash_tree, html_text, language_id, licenses, merkle, mixing, oracles, quality, repeats, simhash, token_rollup
from .common import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.replay(table(spark, sf_dir, "documents"), scratch_path(spark, "token-rollup"))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard_table(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flag_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_table(table(spark, sf_dir, "documents"))


def op9_longest_previous_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest_table(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_table(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest_table(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_token_rollup, op3_soft_mixing, op4_hash_tree, op5_decontaminate, op6_simhash, op7_html_text, op8_license_scan, op9_longest_previous_factor, op10_language_id,
        op11_merkle_fingerprint, op12_filter_audit, op13_fill_in_middle,
    )
}

SQL: dict[str, str] = {
    "op1_quality_rules": oracles.op1(), "op4_hash_tree": oracles.op4(), "op5_decontaminate": oracles.op5(), "op9_longest_previous_factor": oracles.op9(),
    "op11_merkle_fingerprint": oracles.op11(), "op12_filter_audit": oracles.op12(), "op13_fill_in_middle": oracles.op13(),
}
