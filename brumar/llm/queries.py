"""Queries of the problems on text, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brumar.common import table
from brumar.llm.defects import judged
from brumar.llm.lookalike import alike_classes, alike_pairs, with_consistent
from brumar.llm.mixing import mixed
from brumar.llm.overlap import cross_split, linked_classes, prompts_of
from brumar.llm.pii import found
from brumar.llm.tokens import encoded, round_trip


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return judged(table(spark, d, "train_data"), "train_id", "messages").select("train_id", "defect")


def p2_defects(spark: SparkSession, d: str) -> DataFrame:
    """Number of records by defect and source."""
    train = table(spark, d, "train_data")
    return judged(train, "train_id", "messages").join(train.select("train_id", "sursa"), "train_id").groupBy("defect", "sursa").agg(F.count(F.lit(1)).alias("n_records"))


def _prompts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    test = table(spark, d, "test_data_zero_shot")
    return prompts_of(table(spark, d, "train_data")), test.select(F.col("test_id").alias("id"), F.col("user_prompt").alias("text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return cross_split(*_prompts(spark, d)).select("train_id", "test_id")


def p3_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records, those that training repeats, how many pairs and how much of them is covered, by split and source."""
    test = table(spark, d, "test_data_zero_shot").select("test_id", "split", "sursa")
    hits = linked_classes(*_prompts(spark, d)).select(F.col("id").alias("test_id"), "n_train", "covered")
    got = test.join(hits, "test_id", "left").groupBy("split", "sursa")
    return got.agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("n_train") > 0).alias("n_repeated"), F.coalesce(F.sum("n_train"), F.lit(0)).alias("n_pairs"), F.round(F.avg(F.coalesce("covered", F.lit(0.0))), 6).alias("mean_covered"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation record with its class, the training classes and rows linked to it and its coverage."""
    return linked_classes(*_prompts(spark, d)).withColumnRenamed("id", "test_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return alike_pairs(table(spark, d, "formatted_diagnoses"), "diag_id", "original_diagnosis").select(F.col("a").alias("diag_id_a"), F.col("b").alias("diag_id_b"))


def p5_consistent(spark: SparkSession, d: str) -> DataFrame:
    return with_consistent(table(spark, d, "formatted_diagnoses").select("diag_id", "original_diagnosis"), "original_diagnosis").select("diag_id", "consistent")


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every report with the class of texts that look like its own, and how many rows and spellings the class has."""
    return alike_classes(table(spark, d, "formatted_diagnoses"), "diag_id", "original_diagnosis")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(table(spark, d, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """How many documents decode to the text they were encoded from."""
    return round_trip(table(spark, d, "documents"), "doc_id", "text").groupBy("same").agg(F.count(F.lit(1)).alias("n_documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixed(table(spark, d, "documents"), table(spark, d, "mix_target"), "doc_id", "text", "source")[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixed(table(spark, d, "documents"), table(spark, d, "mix_target"), "doc_id", "text", "source")[1]


def _found(spark: SparkSession, d: str) -> DataFrame:
    return found(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "prenume_ref"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("doc_id", F.explode("items").alias("i")).select("doc_id", "i.tip", "i.poz")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("doc_id", "redacted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_defects, p3_found, p3_by_split, p3_classes, p5_found, p5_consistent, p5_classes, p7_ids, p7_round_trip, p8_mix, p8_shares, p9_found, p9_redacted)}


def oracle_sql() -> dict[str, str]:
    """Encoding and decoding must give every text again, so the documents can be counted in SQL; the rest is beyond SQL and tested against brute force."""
    return {"p7_round_trip": "SELECT TRUE AS same, count(*) AS n_documents FROM documents"}
