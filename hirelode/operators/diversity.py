"""A spread of records: each next one is the farthest from those taken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, written


def diverse(df: DataFrame, group: str, key: str, words: str, target: int) -> DataFrame:
    """``group, key, place``: up to ``target`` records per group, starting with the least key.

    The choice is sequential by nature, so it takes a round per place; within a
    round all records keep their least distance to those taken, and the farthest
    of each group, ties to the lower key, is sent to every task (a row a group).
    """
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.array_distinct(F.coalesce(words, F.array().cast(dict(df.dtypes)[words]))).alias("w"))
    rest = written(rows.withColumn("n", F.monotonically_increasing_id()), "spread").withColumn("far", F.lit(2.0))
    taken: list[DataFrame] = []
    for place in range(1, target + 1):
        least = F.min(F.struct((-F.col("far")).alias("near"), F.col("k").isNull().alias("none"), "k", "n", "w")).alias("p")
        pick = cut(rest.groupBy("g").agg(least).select("g", F.col("p.k").alias("pk"), F.col("p.n").alias("pn"), F.col("p.w").alias("pw")))
        taken.append(pick.select(F.col("g").alias(group), F.col("pk").alias(key), F.lit(place).alias("place")))
        if place == target or pick.isEmpty():
            break
        common = F.size(F.array_intersect("w", "pw"))
        union = F.size("w") + F.size("pw") - common
        left = rest.join(F.broadcast(pick), "g").where("n <> pn")
        rest = written(left.select("g", "k", "w", "n", F.least("far", F.when(union > 0, 1 - common / union).otherwise(F.lit(0.0))).alias("far")), "spread")
    return reduce(DataFrame.unionByName, taken)
