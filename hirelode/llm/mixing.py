"""Texts of several sources mixed to target shares of the tokens.

The size of a mixture is the largest at which every source can give its share
without a text being used more than the allowed times.  A source's texts, in a
permuted order of their own for every pass over it, form blocks of about equal
size; a splitting tree deals each source's exact number of blocks to the output
shards by multivariate hypergeometric draws, so that each shard is a fair
sample of the mixture; a shard takes disjoint blocks and is shuffled by itself.
The tree is nowhere written out: a node's draw is keyed by its place, and a task
descends only to the shards of its own blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.tables import cut
from .ordered import running_sums
from .tokens import VOCABULARY, token_counts

BLOCK_TOKENS, SHARD_BLOCKS = 4096, 64
#: Beyond this many blocks of a mixture (2 T tokens) blocks become larger; a draw takes less than a billion.
MAX_BLOCKS = 500_000_000
MAX_TARGETS = 10_000


def _left(key: Sequence[int], lo: int, hi: int, quotas: np.ndarray) -> np.ndarray:
    """The blocks of each source that go to the left half of the shards ``lo`` to ``hi``; always the same for a node."""
    total, mid = int(quotas.sum()), (lo + hi) // 2
    size = total * (mid - lo) // (hi - lo)
    rng = np.random.default_rng([*key, lo, hi])
    return rng.multivariate_hypergeometric(quotas, size, method="marginals") if total else quotas * 0


def shards_of(quotas: np.ndarray, shards: int, key: Sequence[int], source: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shard of each block, given by its source and its rank among that source's blocks: only nodes above these blocks are drawn."""
    out = np.zeros(len(rank), np.int64)
    todo = [(0, shards, quotas.astype(np.int64), np.arange(len(rank)), rank.astype(np.int64))]
    while todo:
        lo, hi, q, at, r = todo.pop()
        if not len(at):
            continue
        if hi - lo == 1:
            out[at] = lo
            continue
        left = _left(key, lo, hi, q)
        own = left[source[at]]
        goes = r < own
        mid = (lo + hi) // 2
        todo += [(lo, mid, left, at[goes], r[goes]), (mid, hi, q - left, at[~goes], (r - own)[~goes])]
    return out


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]]) -> dict[str, float]:
    """Tokens each source gives; a source of the targets that has no text gives 0 and its share falls to the others in proportion."""
    there = [(s, w, r) for s, w, r in targets if sizes.get(s, 0) > 0 and w > 0 and r >= 1]
    if not there:
        return {}
    share = sum(w for _, w, _ in there)
    whole = min(r * sizes[s] * share / w for s, w, r in there)
    return {s: whole * w / share for s, w, _ in there}


def mixture(documents: DataFrame, mix_targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """``(rows, shares)``.

    ``rows``: ``mix_id, shard, position, doc_id, source, pass_no, n_tokens``, one
    per use of a text; ``position`` counts from 1 in the shard.  ``shares``:
    ``mix_id, source, target_share, actual_share, n_texts, most_repeats,
    n_tokens`` for every target.  A null or negative share is 0, null repeats are
    1, a source of no repeats isn't used, repeated targets count by the first in order.  Texts without tokens or of
    sources without a target aren't used.  More than :data:`MAX_TARGETS` targets
    raise ``ValueError``.
    """
    spark = documents.sparkSession
    listed = mix_targets.where("mix_id is not null and source is not null").select("mix_id", "source", "target_share", "max_repeats").limit(MAX_TARGETS + 1).collect()
    if len(listed) > MAX_TARGETS:
        raise ValueError("too many targets")
    targets: dict[int, dict[str, tuple[float, int]]] = {}
    for r in sorted(listed, key=lambda r: (r[0], r[1], -(r[2] or 0))):
        targets.setdefault(int(r[0]), {}).setdefault(r[1], (max(0.0, float(r[2] or 0)), 1 if r[3] is None else int(r[3])))
    names = spark.createDataFrame([(s,) for s in sorted({s for t in targets.values() for s in t})] or [("",)], "source string")
    counts = cut(token_counts(documents, vocabulary).where("n_tokens > 0 and source is not null").join(F.broadcast(names), "source"))  # at most MAX_TARGETS names
    sizes = {r["source"]: int(r["n"]) for r in counts.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    quota = [(m, s, float(q), float(sizes[s])) for m, t in targets.items() for s, q in plan(sizes, [(s, *v) for s, v in t.items()]).items()]
    quotas = spark.createDataFrame(quota, "mix_id int, source string, quota double, size double")
    uses = counts.join(F.broadcast(quotas), "source")
    passes = F.sequence(F.lit(0), F.ceil(F.col("quota") / F.col("size") - 1e-9).cast("int") - 1)
    uses = uses.where("quota > 0").select("mix_id", "source", "quota", "size", "doc_id", "n_tokens", F.explode(passes).alias("pass_no"))
    uses = uses.withColumn("key", F.xxhash64("doc_id", "mix_id", "pass_no", F.lit(seed)))
    # texts long against what a pass gives come last, so that none of them makes the share jump
    left = F.least(F.col("quota") - F.col("pass_no") * F.col("size"), F.col("size"))
    uses = uses.withColumn("late", (F.col("n_tokens") > left / 20).cast("int"))
    uses = running_sums(uses, ["mix_id", "source", "pass_no"], ["late", "key", "doc_id"], "n_tokens")
    # of the last pass those texts whose middle lies within what is left of the quota
    uses = uses.where(F.col("before") + F.col("n_tokens") / 2 <= F.col("quota") - F.col("pass_no") * F.col("size"))
    whole: dict[int, float] = {}
    for m, _, q, _ in quota:
        whole[m] = whole.get(m, 0.0) + q
    step = spark.createDataFrame([(m, max(BLOCK_TOKENS, ceil(w / MAX_BLOCKS))) for m, w in whole.items()], "mix_id int, block_tokens bigint")
    uses = uses.join(F.broadcast(step), "mix_id")  # a row a mixture
    per_pass = F.ceil(F.col("size") / F.col("block_tokens"))
    uses = cut(uses.select("mix_id", "source", "pass_no", "doc_id", "n_tokens", "key", (F.col("pass_no") * per_pass + F.floor(F.col("before") / F.col("block_tokens"))).cast("bigint").alias("block")))
    blocks = {(r["mix_id"], r["source"]): int(r["n"]) + 1 for r in uses.groupBy("mix_id", "source").agg(F.max("block").alias("n")).collect()}  # one row a target
    deal: dict[int, tuple] = {}
    order_of: list[tuple] = []
    for m in targets:
        own = [(s, n) for (mm, s), n in sorted(blocks.items()) if mm == m]
        if not own:
            continue
        n = np.array([k for _, k in own], np.int64)
        deal[m] = (n, max(1, ceil(int(n.sum()) / SHARD_BLOCKS)))
        rng = np.random.default_rng([seed, m])
        for j, (s, k) in enumerate(own):
            step = int(rng.integers(1, k + 1))
            while gcd(step, k) != 1:
                step += 1
            order_of.append((m, s, j, k, step % k if k > 1 else 0, int(rng.integers(0, k))))
    # a permuted rank of each block; ranges of its share of the source keep a task to few shards
    orders = spark.createDataFrame(order_of, "mix_id int, source string, _j int, _k bigint, _step bigint, _shift bigint")
    ranked = uses.join(F.broadcast(orders), ["mix_id", "source"]).withColumn("_rank", (F.col("block") * F.col("_step") + F.col("_shift")) % F.col("_k"))
    ranked = ranked.withColumn("_share", F.col("_rank") / F.col("_k")).repartitionByRange("mix_id", "_share", "key")
    ranked = ranked.select("mix_id", "source", "pass_no", "doc_id", "n_tokens", "key", "_j", "_rank")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            shard = np.zeros(len(f), np.int64)
            for m, at in f.groupby("mix_id").indices.items():
                n, shards = deal[m]
                shard[at] = shards_of(n, shards, [seed, m], f["_j"].to_numpy()[at], f["_rank"].to_numpy()[at])
            yield f.drop(columns=["_j", "_rank"]).assign(shard=shard)

    placed = ranked.mapInPandas(place, "mix_id int, source string, pass_no int, doc_id bigint, n_tokens bigint, key bigint, shard bigint")
    # a shard holds SHARD_BLOCKS blocks on average, whatever the input's size
    order = W.partitionBy("mix_id", "shard").orderBy(F.xxhash64("key", F.lit(seed + 1)), "doc_id", "pass_no")
    rows = placed.select("mix_id", "shard", F.row_number().over(order).alias("position"), "doc_id", "source", "pass_no", "n_tokens")
    each = uses.groupBy("mix_id", "source", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n"))
    got = each.groupBy("mix_id", "source").agg(F.count("*").alias("n_texts"), F.max("k").alias("most_repeats"), F.sum("n").alias("n_tokens"))
    want = spark.createDataFrame([(m, s, w) for m, t in targets.items() for s, (w, _) in t.items()], "mix_id int, source string, target_share double")
    d = want.join(got, ["mix_id", "source"], "left").fillna(0, ["n_texts", "most_repeats", "n_tokens"])
    whole = F.sum("n_tokens").over(W.partitionBy("mix_id"))
    shares = d.select("mix_id", "source", "target_share", F.round(F.when(whole > 0, F.col("n_tokens") / whole).otherwise(0.0), 6).alias("actual_share"), "n_texts", "most_repeats", "n_tokens")
    return rows, shares
