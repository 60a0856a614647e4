"""Joins on keys of which a few may bear a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of the rows is met by broadcast: there are at most 1 / SHARE of them.
SHARE = 1 / 2000


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], weight: str, total: int, share: float = SHARE) -> DataFrame:
    """The inner join of ``left`` with ``right``, which has a key once and tells by ``weight`` how many of ``left``'s ``total`` rows bear it.

    The keys with at least ``share`` of the rows, at most ``1 / share`` by count,
    are sent to every task; the rows of the others are shuffled, and no key is
    hot among them.  Keys are not null; ``right`` brings at least one column,
    and is best stored, as it is read twice.
    """
    least = max(2, int(share * total))
    own = [c for c in right.columns if c not in (*on, weight)]
    mark = F.lit(True).alias("_met")
    frequent = right.where(F.col(weight) >= least).select(*on, *own, mark)
    met = left.join(F.broadcast(frequent), list(on), "left")
    rest = met.where("_met is null").drop("_met", *own).join(right.where(F.col(weight) < least).select(*on, *own), list(on))
    return met.where("_met").drop("_met").unionByName(rest)
