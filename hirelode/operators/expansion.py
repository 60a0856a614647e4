"""Terms of a profile widened by a taxonomy: labels, vectors, graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def term_rows(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """``key, pos, term`` of an array of terms; trimmed, empty ones dropped, the first of a spelling (case folded) kept."""
    d = df.select(key, F.posexplode(terms).alias("pos", "term")).select(key, "pos", F.trim("term").alias("term")).where("term <> ''")
    w = W.partitionBy(key, F.lower("term")).orderBy("pos")
    return d.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def expand_exact(rows: DataFrame, key: str, labels: DataFrame, per_term: int = 3) -> DataFrame:
    """``key, place, term``: the terms, then up to ``per_term`` other labels of each, repeated spellings left out.

    ``labels``: ``label, alt_no, alt``; a term is a label if equal but for case.
    """
    own = rows.select(key, F.lit(0).alias("part"), F.col("pos").alias("a"), F.lit(0).alias("b"), "term")
    alts = labels.where(F.col("alt_no") <= per_term)
    more = rows.join(alts, F.lower("term") == F.lower("label")).select(key, F.lit(1).alias("part"), F.col("pos").alias("a"), F.col("alt_no").alias("b"), F.col("alt").alias("term"))
    return placed(own.unionByName(more), key)


def placed(parts: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    """Terms in the order of ``part, a, b, term`` without repeated spellings; ``cap`` cuts the list where that is the feature."""
    first = parts.groupBy(key, F.lower("term").alias("_t")).agg(F.min(F.struct("part", "a", "b", "term")).alias("_o"))
    w = W.partitionBy(key).orderBy("_o")
    out = first.select(key, F.row_number().over(w).alias("place"), F.col("_o.term").alias("term"))
    return out if cap is None else out.where(F.col("place") <= cap)


def neighbours(edges: DataFrame, start: DataFrame, up: tuple[str, str], cap: int | None = None) -> DataFrame:
    """``src, title, place``: nodes that share a node with ``src`` over two edges of the given kinds, by title; a node isn't its own neighbour.

    With a cap each shared node first keeps as many of its nodes, and one more for
    ``src`` itself: no more of them can be among the first.
    """
    a = edges.where(F.col("kind") == up[0]).join(start, "src", "left_semi").select("src", F.col("dst").alias("mid")).distinct()
    b = edges.where(F.col("kind") == up[1]).select(F.col("src").alias("mid"), F.col("dst").alias("other"), F.col("title")).distinct()
    if cap is not None:
        b = b.withColumn("_n", F.row_number().over(W.partitionBy("mid").orderBy("title", "other"))).where(F.col("_n") <= cap + 1).drop("_n")
    met = a.join(b, "mid").where("src <> other").select("src", "other", "title").distinct()
    w = W.partitionBy("src").orderBy("title", "other")
    out = met.withColumn("place", F.row_number().over(w))
    return (out if cap is None else out.where(F.col("place") <= cap)).select("src", "title", "place")


def expand_near(near: DataFrame, labels: DataFrame, least: float, cap: int, per_concept: int = 2) -> DataFrame:
    """``query, place, term``: a term (``v`` and its number), then up to ``per_concept`` other labels of each concept that is near enough, ``cap`` in all.

    ``near``: ``query, doc, score, rank`` with ``score = (1 + cosine) / 2``;
    ``labels``: ``doc, alts``.
    """
    own = near.select("query").distinct().select("query", F.lit(0).alias("part"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.concat(F.lit("v"), "query").alias("term"))
    good = near.where(2 * F.col("score") - 1 >= least).join(labels, "doc")
    more = good.select("query", F.lit(1).alias("part"), F.col("rank").alias("a"), F.posexplode(F.slice("alts", 1, per_concept)).alias("b", "term")).withColumn("b", F.col("b") + 1)
    return placed(own.unionByName(more.select(*own.columns)), "query", cap)
