"""Consensus of several annotators' scores by latent ability and difficulty.

Every item has a hidden class (score reaches the threshold or not) and a
difficulty, every annotator a skill.  With probability ``sigmoid(skill *
easiness)`` an annotator's score comes from their own habit for that class (a
histogram of the scores they give), else from the scores they give in general.
Expectation-maximisation with gradient steps learns skills and easiness jointly
with the habits, so a harsh, a generous, a constant and a careless annotator are
told apart.  Items stay distributed: one pass over them per round sends only
sums per annotator to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut

LEVELS = 11
#: Annotators' parameters are sent to every task; more annotators than this raise ValueError.
MAX_ANNOTATORS = 100_000
#: Rounds end when no skill and no habit moves by more than SETTLED, or after ROUNDS.
ROUNDS, INNER, SETTLED = 40, 4, 0.02


def annotation_labels(annotations: DataFrame) -> DataFrame:
    """``table_name, item_key, annotator, score``: each annotator's last valid ``skills_match`` of a CV–job pair.

    Scores that are null or outside 0–10, and rows without a key or annotator,
    are left out; of several scores the later ``annotated_at`` counts, then the
    later ``loaded_at``, then the higher score.
    """
    d = annotations.select(
        F.lit("annotations").alias("table_name"),
        F.concat_ws("|", F.when(F.col("cv_id").isNotNull() & F.col("job_id").isNotNull(), F.col("cv_id")), "job_id").alias("item_key"),
        "annotator",
        F.col("skills_match").cast("int").alias("score"),
        F.struct("annotated_at", "loaded_at", "skills_match").alias("at"),
    ).where("score between 0 and 10 and annotator is not null and item_key like '%|%'")
    return d.groupBy("table_name", "item_key", "annotator").agg(F.max_by("score", "at").alias("score"))


def adjudicated_labels(cases: DataFrame) -> DataFrame:
    """The three models' ``relevance_score`` of each ``pair_key``, as :func:`annotation_labels` gives them; of repeated cases the last ``case_index`` counts."""
    models = ("cohere", "gptoss", "llama")
    each = F.array(*[F.struct(F.lit(m).alias("annotator"), F.col(f"original_model_scores.{m}.relevance_score").cast("int").alias("score")) for m in models])
    d = cases.select(F.lit("adjudicated_cases").alias("table_name"), F.col("pair_key").alias("item_key"), "case_index", F.inline(each))
    d = d.where("score between 0 and 10 and item_key is not null")
    return d.groupBy("table_name", "item_key", "annotator").agg(F.max_by("score", F.struct("case_index", "score")).alias("score"))


def _posteriors(who: np.ndarray, score: np.ndarray, offsets: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: each item's posterior and log easiness, each label's share of the informed branch under either class."""
    n, lens = len(offsets) - 1, np.diff(offsets)
    item = np.repeat(np.arange(n), lens)
    h0, h1, g, skill = p["h0"][who, score], p["h1"][who, score], p["g"][who, score], p["skill"][who]
    ease, at = np.zeros(n), offsets[:-1]
    prior = np.log(p["prior"] / (1 - p["prior"]))
    for _ in range(INNER):
        s = 1 / (1 + np.exp(-np.clip(skill * np.exp(ease[item]), -30, 30)))
        l0, l1 = s * h0 + (1 - s) * g, s * h1 + (1 - s) * g
        z = 1 / (1 + np.exp(-np.clip(np.add.reduceat(np.log(l1) - np.log(l0), at) + prior, -60, 60)))
        r0, r1 = s * h0 / l0, s * h1 / l1
        r = z[item] * r1 + (1 - z[item]) * r0
        b = skill * np.exp(ease[item])
        grad = np.add.reduceat((r - s) * b, at) - ease
        hess = np.add.reduceat(s * (1 - s) * b * b, at) + 1.0
        ease = np.clip(ease + np.clip(grad / hess, -1, 1), -2, 2)
    return z, ease, r0, r1


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("labels")
    flat = lists.flatten()
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    codes = flat.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes // LEVELS, codes % LEVELS, offsets


def _pass(p: dict):
    """One expectation step: sums per annotator, as ``(annotator, k, v)`` with k over both histograms, gradient, curvature and prior."""
    size = 2 * LEVELS + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(p["skill"]), size))
        for batch in batches:
            if not batch.num_rows:
                continue
            who, score, offsets = _columns(batch)
            z, ease, r0, r1 = _posteriors(who, score, offsets, p)
            item = np.repeat(np.arange(len(z)), np.diff(offsets))
            zi, b = z[item], np.exp(ease[item])
            s = 1 / (1 + np.exp(-np.clip(p["skill"][who] * b, -30, 30)))
            np.add.at(sums, (who, score), (1 - zi) * r0)
            np.add.at(sums, (who, LEVELS + score), zi * r1)
            np.add.at(sums[:, 2 * LEVELS], who, (zi * r1 + (1 - zi) * r0 - s) * b)
            np.add.at(sums[:, 2 * LEVELS + 1], who, s * (1 - s) * b * b)
            sums[0, 2 * LEVELS + 2] += z.sum()
            sums[0, 2 * LEVELS + 3] += len(z)
        a, k = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(sums[a, k])], names=["a", "k", "v"])

    return run


def fit(items: DataFrame, annotators: int, marginals: np.ndarray) -> dict:
    """The parameters once they have settled.  ``items.labels`` holds ``annotator * 11 + score``; ``marginals`` each annotator's counts of scores."""
    g = (marginals + 0.5) / (marginals + 0.5).sum(1, keepdims=True)
    # at the start the upper part of each annotator's own scores leans to the upper class
    rank = np.cumsum(g, 1) - g / 2
    level = np.arange(LEVELS) / (LEVELS - 1)
    lean = 1 / (1 + np.exp(-6 * ((rank + level[None, :]) / 2 - 0.5)))
    h1, h0 = g * lean, g * (1 - lean)
    p = {"h0": h0 / h0.sum(1, keepdims=True), "h1": h1 / h1.sum(1, keepdims=True), "g": g, "skill": np.ones(annotators), "prior": 0.5}
    for _ in range(ROUNDS):
        sums = np.zeros((annotators, 2 * LEVELS + 4))
        rows = items.mapInArrow(_pass(p), "a int, k int, v double").groupBy("a", "k").agg(F.sum("v").alias("v")).toPandas()  # at most 26 numbers an annotator
        sums[rows["a"], rows["k"]] = rows["v"]
        before = {k: p[k] for k in ("h0", "h1", "skill")}
        h0 = sums[:, :LEVELS] + g
        h1 = sums[:, LEVELS : 2 * LEVELS] + g
        p["h0"], p["h1"] = h0 / h0.sum(1, keepdims=True), h1 / h1.sum(1, keepdims=True)
        step = (sums[:, -4] - (p["skill"] - 1)) / (sums[:, -3] + 1)
        p["skill"] = np.clip(p["skill"] + np.clip(step, -1, 1), -6, 6)
        p["prior"] = float(np.clip((sums[0, -2] + 1) / (sums[0, -1] + 2), 0.02, 0.98))
        if max(float(np.abs(p[k] - v).max()) for k, v in before.items()) <= SETTLED:
            break
    return p


def _scored(p: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            who, score, offsets = _columns(batch)
            z, ease, _, _ = _posteriors(who, score, offsets, p)
            yield pa.RecordBatch.from_arrays(
                [batch.column("table_name"), batch.column("item_key"), pa.array(z), pa.array(-ease), pa.array(np.diff(offsets).astype(np.int32))],
                names=["table_name", "item_key", "posterior", "difficulty", "n_labels"],
            )

    return run


def consensus(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (``table_name, item_key, posterior, difficulty, n_labels``) and annotators (``annotator, skill, reliability, habit_shift, n_labels``).

    ``labels`` has one row per item and annotator.  ``reliability`` is how far
    the annotator's habits of the two classes are apart, weighed by skill (0:
    the score tells nothing, 1: everything); ``habit_shift`` the mean score they
    give above that of all.  Annotators are shared by the tables.  Without
    labels both are empty.
    """
    spark: SparkSession = labels.sparkSession
    labels = cut(labels)
    if labels.select("annotator").distinct().limit(MAX_ANNOTATORS + 1).count() > MAX_ANNOTATORS:
        raise ValueError("more annotators than are sent to every task")
    counts = labels.groupBy("annotator", "score").count().toPandas()  # at most 11 rows an annotator
    names = sorted(counts["annotator"].unique())
    if not names:
        empty_items = spark.createDataFrame([], "table_name string, item_key string, posterior double, difficulty double, n_labels int")
        return empty_items, spark.createDataFrame([], "annotator string, skill double, reliability double, habit_shift double, n_labels bigint")
    index = {a: i for i, a in enumerate(names)}
    marginals = np.zeros((len(names), LEVELS))
    for a, s, n in counts.itertuples(index=False):
        marginals[index[a], s] += n
    numbers = spark.createDataFrame([(a, i) for a, i in index.items()], "annotator string, a int")
    coded = labels.join(F.broadcast(numbers), "annotator").select("table_name", "item_key", (F.col("a") * LEVELS + F.col("score")).alias("c"))
    # one label an annotator: a list is at most as long as the checked number of annotators
    items = coded.groupBy("table_name", "item_key").agg(F.sort_array(F.collect_list("c")).alias("labels"))
    items = cut(items)
    p = fit(items, len(names), marginals)
    out = items.mapInArrow(_scored(p), "table_name string, item_key string, posterior double, difficulty double, n_labels int")
    apart = 0.5 * np.abs(p["h1"] - p["h0"]).sum(1) / (1 + np.exp(-p["skill"]))
    mean = (marginals * np.arange(LEVELS)).sum(1) / marginals.sum(1)
    shift = mean - (marginals.sum(0) * np.arange(LEVELS)).sum() / marginals.sum()
    people = [(a, float(p["skill"][i]), float(apart[i]), float(shift[i]), int(marginals[i].sum())) for a, i in index.items()]
    return out, spark.createDataFrame(people, "annotator string, skill double, reliability double, habit_shift double, n_labels bigint")


def agreement(labels: DataFrame, threshold: int = 6) -> DataFrame:
    """``table_name, n_items, observed, expected, kappa``: chance-corrected agreement of all pairs of annotators on score ≥ ``threshold``.

    Items with one label don't count.  Where the annotators give one class only,
    ``kappa`` is null.
    """
    per = labels.groupBy("table_name", "item_key").agg(F.count("*").cast("double").alias("n"), F.sum((F.col("score") >= threshold).cast("double")).alias("k")).where("n > 1")
    agree = (F.col("k") * (F.col("k") - 1) + (F.col("n") - F.col("k")) * (F.col("n") - F.col("k") - 1)) / (F.col("n") * (F.col("n") - 1))
    d = per.groupBy("table_name").agg(F.count("*").alias("n_items"), F.avg(agree).alias("o"), (F.sum("k") / F.sum("n")).alias("q"))
    d = d.withColumn("e", F.col("q") * F.col("q") + (1 - F.col("q")) * (1 - F.col("q")))
    return d.select("table_name", "n_items", F.round("o", 6).alias("observed"), F.round("e", 6).alias("expected"), F.round(F.when(F.col("e") < 1, (F.col("o") - F.col("e")) / (1 - F.col("e"))), 6).alias("kappa"))
