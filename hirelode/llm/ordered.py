"""Running sums over an order of all rows, without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.tables import cut

#: Offsets are sent to every task.
MAX_OFFSETS = 1_000_000


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``df`` with ``before``, the sum of ``value`` over the group's earlier rows, and ``total``, over all.

    The rows are range-partitioned by group and order and sorted; each partition
    adds up its own rows, and the partitions' sums give the offsets.  As ranges
    go on through the groups, there are at most as many offsets as partitions
    and groups together; more than :data:`MAX_OFFSETS` raise ``ValueError``.
    ``value`` is an integer without nulls; ``order`` must tell the rows of a
    group apart.
    """
    by = [*group, *order]
    placed = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            if f.empty:
                continue
            grouped = f.groupby(list(group), sort=False, dropna=False)[value]
            keys = list(map(tuple, f[list(group)].itertuples(index=False)))
            before = np.array([held.get(k, 0) for k in keys], dtype=np.int64)
            inner = (grouped.cumsum() - f[value]).to_numpy(np.int64)
            out = f.assign(_in=inner + before)
            last = dict(zip(keys, (inner + before + f[value].to_numpy(np.int64))))
            held.update(last)
            yield out

    types = ", ".join(f"`{n}` {t}" for n, t in placed.dtypes) + ", _in bigint"
    local = placed.mapInPandas(sums, types)
    per = cut(placed.groupBy(*group, "_part").agg(F.sum(value).alias("_n")))
    if per.count() > MAX_OFFSETS:
        raise ValueError("more groups than are sent to every task")
    w = W.partitionBy(*group)
    offsets = per.select(*group, "_part", (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_off"), F.sum("_n").over(w).alias("total"))
    return local.join(F.broadcast(offsets), [*group, "_part"]).withColumn("before", F.col("_in") + F.col("_off")).drop("_in", "_off", "_part")
