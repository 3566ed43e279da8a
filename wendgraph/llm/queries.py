"""The driver's queries over the training-text operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import licenses, preference
from .shared import table


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.pairs(preference.with_borrowed_replies(table(spark, sf_dir, "conversations")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_neardup": op1_neardup,
    "op6_substrings": op6_substrings,
    "op8_media": op8_media,
    "op2_licenses": op2_licenses,
    "op10_preference": op10_preference,
    "op3_pii": op3_pii,
    "op5_toxicity": op5_toxicity,
    "op4_language": op4_language, "op7_decontamination": op7_decontamination, "op9_packing": op9_packing}
SQL = {"op2_licenses": licenses.sql(), "op10_preference": preference.sql()}
