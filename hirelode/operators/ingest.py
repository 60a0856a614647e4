"""Bringing crawled records in: duplicates, pre-check, upsert, expiry, quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_seen(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order, which must tell rows apart."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, as repeated writes by key leave it; map-side combined, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, "_r.*").select(*df.columns)


def upsert_actions(existing: DataFrame, incoming: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, action, digest``: ``insert``, ``update``, ``touch`` or ``keep`` for every key of either side.

    Each side has a key at most once.  Rows without a key are skipped.
    """
    old = existing.where(F.col(key).isNotNull()).select(F.col(key), F.col(digest).alias("_old"), F.lit(True).alias("_has"))
    new = incoming.where(F.col(key).isNotNull()).select(F.col(key), F.col(digest).alias("_new"), F.lit(True).alias("_comes"))
    both = old.join(new, key, "full")
    action = F.when(F.col("_comes").isNull(), "keep").when(F.col("_has").isNull(), "insert").when(F.col("_old").eqNullSafe(F.col("_new")), "touch").otherwise("update")
    return both.select(key, action.alias("action"), F.coalesce("_new", "_old").alias(digest))


def merged(existing: DataFrame, incoming: DataFrame, key: str, digest: str, touched: str, as_of: Column) -> DataFrame:
    """The table after an upsert: new rows in, changed rows replaced, unchanged ones only marked as seen; a repeat changes nothing."""
    cols = existing.columns
    new = incoming.where(F.col(key).isNotNull()).select(*[F.col(c).alias(f"_n_{c}") for c in cols if c != touched], F.lit(True).alias("_comes"))
    both = existing.join(new, F.col(key) == F.col(f"_n_{key}"), "full")
    pick = lambda c: F.when(F.col("_comes") & ~F.col(digest).eqNullSafe(F.col(f"_n_{digest}")), F.col(f"_n_{c}")).otherwise(F.coalesce(F.col(c), F.col(f"_n_{c}"))) if c != key else F.coalesce(c, f"_n_{c}")
    return both.select(*[(F.when(F.col("_comes"), as_of).otherwise(F.col(c)) if c == touched else pick(c)).alias(c) for c in cols])


def precheck(urls: DataFrame, known: DataFrame, as_of: Column, days: int) -> DataFrame:
    """``url, status``: ``new`` without a record, ``recrawl`` if that is older than ``days`` or undated, else ``skip``; negative days never."""
    seen = known.groupBy("url").agg(F.max("seen_at").alias("seen_at"), F.lit(True).alias("_has"))
    d = urls.select("url").where("url is not null and trim(url) <> ''").distinct().join(seen, "url", "left")
    old = F.lit(days >= 0) & (F.col("seen_at").isNull() | (F.datediff(as_of, F.col("seen_at")) >= days))
    return d.select("url", F.when(F.col("_has").isNull(), "new").when(old, "recrawl").otherwise("skip").alias("status"))


def quota_fill(candidates: DataFrame, existing: DataFrame, strata: Sequence[str], order: Sequence[str], quota: int) -> DataFrame:
    """Candidates in order of arrival while their stratum has room beside what is there."""
    have = existing.groupBy(*strata).agg(F.count("*").alias("_have"))
    w = W.partitionBy(*strata).orderBy(*order)
    ranked = candidates.withColumn("place", F.row_number().over(w)).where(F.col("place") <= quota)  # no stratum has more room
    return ranked.join(have, list(strata), "left").where(F.col("place") <= F.lit(quota) - F.coalesce("_have", F.lit(0))).drop("_have")


def interleaved(lists: DataFrame, group: str, level: str, order: Sequence[str], item: str) -> DataFrame:
    """Ordered lists of a group dealt in turn, the first of an item kept: ``group, item, place``."""
    at = W.partitionBy(group, level).orderBy(*order)
    d = lists.withColumn("_p", F.row_number().over(at)).select(group, item, F.struct("_p", level).alias("_o"))
    first = d.groupBy(group, item).agg(F.min("_o").alias("_o"))
    w = W.partitionBy(group).orderBy("_o", item)
    return first.select(group, item, F.row_number().over(w).alias("place"))
