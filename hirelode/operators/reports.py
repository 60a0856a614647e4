"""Counts and shares over records, annotators and caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def distribution(df: DataFrame, by: Column, name: str) -> DataFrame:
    """``name, n, percent`` of each value; the total is that of the few counted rows."""
    counts = df.groupBy(by.alias(name)).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 2))


def cube_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts of all combinations of ``dims`` and their totals (``total`` in place of a value)."""
    given = df.select(*[F.coalesce(d, F.lit("none")).alias(d) for d in dims])
    return given.cube(*dims).agg(F.count("*").alias("n")).fillna("total", list(dims))


def accuracy(df: DataFrame, right: str) -> DataFrame:
    """``n, n_right, accuracy`` of a flag without nulls."""
    flag = F.col(right).cast("double")
    return df.agg(F.count("*").alias("n"), F.sum(F.col(right).cast("bigint")).alias("n_right"), F.round(F.avg(flag), 6).alias("accuracy"))


def disagreement(labels: DataFrame, key: Sequence[str], dims: Sequence[str], limit: int, by: Sequence[str] = ()) -> DataFrame:
    """``dimension, n_items``: items whose greatest and least score differ by more than ``limit``; scores outside 0–10 don't count.

    ``by``: also by these columns of the items, the least value where an item has several.
    """
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score")) for d in dims])
    long = labels.select(*key, *by, F.inline(pairs)).where("score between 0 and 10")
    spread = long.groupBy(*key, "dimension").agg((F.max("score") - F.min("score")).alias("spread"), *[F.min(c).alias(c) for c in by]).where(F.col("spread") > limit)
    return spread.groupBy("dimension", *by).agg(F.count("*").alias("n_items"))
