"""One query for each operator, over its whole table; their columns follow the contracts of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import ctph, decontaminate, divergence, langid, pii, quality, rules, secrets, simhash, spelling, spm, substrings, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.compare_with_edited(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.train_and_predict(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3, shingle=3)
    return found.select(F.col("id").alias("doc_id"), simhash.hex64("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return spm.encode(table(spark, sf_dir, "documents"), spm.Model.load(path or model_path()), digest=True).withColumnRenamed("id", "doc_id")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"), window=13, digest=True).withColumnRenamed("id", "doc_id")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least=3, top=200)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), shortest=7, least=2, every=31, ratio=10)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_fingerprints": op2_fingerprints,
    "op3_url_filter": op3_url_filter,
    "op4_pii": op4_pii,
    "op5_secrets": op5_secrets,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_substrings": op10_substrings,
    "op11_divergence": op11_divergence,
    "op12_spelling": op12_spelling,
    "op13_quality_rules": op13_quality_rules,
}

#: Where SQL can't express a query it is tested against a brute-force version or held-out accuracy.
ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op3_url_filter": urlfilter.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op13_quality_rules": rules.ORACLE,
}
