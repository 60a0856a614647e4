"""Queries over the general preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed_values import fields_as_rows, split_packed
from ..operators.pay_units import pay_candidates
from ..sources.tables import table, texts

PACKED_FIELDS = ["technical_skills", "soft_skills", "languages", "certificates"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    cells = fields_as_rows(texts(spark, d, "jobs"), "job_id", PACKED_FIELDS)
    return split_packed(cells, "cell", "field_name", slash_fields=["soft_skills", "languages"], joined_fields=["languages"])


def p1_value_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many adverts name each value, case folded."""
    return p1_found(spark, d).groupBy("field_name", F.lower("value_text").alias("value_text")).agg(F.count_distinct("job_id").alias("n_jobs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pay = pay_candidates(texts(spark, d, "jobs"), table(spark, d, "salary_units"))
    return pay.select("job_id", "min_vnd", "max_vnd").where("min_vnd is not null and max_vnd is not null")


def p7_units(spark: SparkSession, d: str) -> DataFrame:
    """The unit combination chosen for each advert, its residual, and whether another is as good."""
    return pay_candidates(texts(spark, d, "jobs"), table(spark, d, "salary_units"))


QUERIES = {f.__name__: f for f in (p1_found, p1_value_counts, p7_found, p7_units)}
ORACLE: dict[str, str] = {}
