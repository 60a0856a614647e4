"""Texts packed into containers of fixed capacity: first fit, largest first.

A text longer than a container fills containers of its own and leaves a rest;
the rests and the shorter texts are dealt at random into groups of bounded size,
and each group is packed on its own.  A tournament tree over the containers' free room finds the first
container that still takes a piece in logarithmic time.  A group leaves at most
its last containers part empty, so large groups lose little.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .tokens import VOCABULARY, token_counts

#: Pieces of a group on average: a text brings one at most, and the number of groups follows from that of the texts.
GROUP = 16_384


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each piece (numbered from 0 in order of opening); sizes between 1 and ``capacity``."""
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    out = np.empty(len(sizes), np.int64)
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        at = 1
        while at < leaves:  # the leftmost leaf with room: the winner of the left half if it has any
            at *= 2
            if room[at] < s:
                at += 1
        out[i] = at - leaves
        room[at] -= s
        at //= 2
        while at:
            a, b = room[2 * at], room[2 * at + 1]
            best = a if a > b else b
            if room[at] == best:
                break
            room[at] = best
            at //= 2
    return out


def _pack(f: pd.DataFrame) -> pd.DataFrame:
    capacity = int(f["capacity_tokens"].iloc[0])
    f = f.sort_values(["doc_id", "piece_no"], kind="stable")
    box = first_fit_decreasing(f["n_tokens"].to_numpy(np.int64), capacity)
    return pd.DataFrame({"pack_id": f["pack_id"], "group_no": f["group_no"], "container_no": box, "doc_id": f["doc_id"], "piece_no": f["piece_no"], "start_token": f["start_token"], "n_tokens": f["n_tokens"]})


def packed(documents: DataFrame, pack_sizes: DataFrame, vocabulary: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """``pack_id, container_id, doc_id, piece_no, start_token, n_tokens``: a row per piece of a text and capacity.

    A text up to the capacity is one piece (``piece_no`` 1); a longer one is cut
    into full containers and a rest.  ``container_id`` is ``group:number``, and
    ``row.piece`` of a container that a long text fills.
    Texts without tokens, and capacities that are null or below 1, give no row;
    a repeated ``doc_id`` is as many texts.  ``pack_sizes`` must be a short list
    (more than 1,000 rows raise ``ValueError``).
    """
    packs = [(int(r["pack_id"]), int(r["capacity_tokens"])) for r in pack_sizes.where("pack_id is not null and capacity_tokens >= 1").select("pack_id", "capacity_tokens").distinct().limit(1001).collect()]
    if len(packs) > 1000:
        raise ValueError("too many capacities")
    spark = documents.sparkSession
    sizes = spark.createDataFrame(packs, "pack_id int, capacity_tokens int")
    counts = cut(token_counts(documents, vocabulary).where("n_tokens > 0").withColumn("_row", F.monotonically_increasing_id()))
    groups = max(1, -(-counts.count() // GROUP))
    dealt = counts.crossJoin(F.broadcast(sizes))  # a text has to be packed for every capacity of the short list
    size = F.col("capacity_tokens").cast("bigint")
    full, rest = F.floor(F.col("n_tokens") / size), F.col("n_tokens") % size
    whole = dealt.where(F.col("n_tokens") >= size).select("pack_id", "_row", "doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), full)).alias("piece_no"), size.alias("n_tokens"))
    whole = whole.select("pack_id", F.concat_ws(".", "_row", "piece_no").alias("container_id"), "doc_id", F.col("piece_no").cast("int").alias("piece_no"), ((F.col("piece_no") - 1) * F.col("n_tokens")).alias("start_token"), "n_tokens")
    group = F.pmod(F.xxhash64("doc_id", "_row", F.lit(seed)), F.lit(groups)).cast("int")
    pieces = dealt.where(rest > 0).select("pack_id", "capacity_tokens", group.alias("group_no"), "doc_id", (full + 1).cast("int").alias("piece_no"), (full * size).alias("start_token"), rest.alias("n_tokens"))
    types = "pack_id int, group_no int, container_no bigint, doc_id bigint, piece_no int, start_token bigint, n_tokens bigint"
    # a group is a random share of the texts with one piece of each, about GROUP of them whatever the input's size
    out = pieces.groupBy("pack_id", "group_no").applyInPandas(_pack, types)
    out = out.select("pack_id", F.concat_ws(":", "group_no", "container_no").alias("container_id"), "doc_id", "piece_no", "start_token", "n_tokens")
    return out.unionByName(whole)


def fill_report(rows: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """``pack_id, capacity_tokens, containers, tokens, fill, least_containers``: how full the containers are, and the fewest there could be."""
    per = rows.groupBy("pack_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    d = per.join(F.broadcast(pack_sizes.select("pack_id", "capacity_tokens").distinct()), "pack_id")
    fill = F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    return d.select("pack_id", "capacity_tokens", "containers", "tokens", F.round(fill, 6).alias("fill"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"))


