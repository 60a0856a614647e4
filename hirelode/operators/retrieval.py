"""Lexical and vector retrieval for a table of queries at once, and their fusion.

The index is three stored tables: ``postings(field, term, doc, tf, dl, tag)``,
``stats(field, n, avgdl)`` and ``frequencies(field, term, df)``.  Statistics are
those of all documents; filters apply to what is ranked, and they do so within
the join with the postings: a document's ``tag`` stands for its values in the
filtered fields, and a query says which tags it allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import CONFIG, MatchConfig
from ..sources.tables import cut, written

#: Queries with up to this many pairs of field and term are sent to the postings.
SENT = 500_000
TERM = r"([\p{L}\p{N}]+)"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(1))


class Index(NamedTuple):
    postings: DataFrame
    stats: DataFrame
    frequencies: DataFrame


def postings(docs: DataFrame, key: str, fields: list[str], tag: str | None = None) -> DataFrame:
    """``field, doc, term, tf, dl, tag``: one row per field, document and term, from one scan.

    A field without a term has no row.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("terms")) for f in fields])
    mark = (F.col(tag) if tag else F.lit(0)).cast("int").alias("tag")
    rows = docs.select(F.col(key).alias("doc"), mark, F.inline(pairs)).select("field", "doc", "tag", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return rows.groupBy("field", "doc", "term", "dl", "tag").agg(F.count("*").alias("tf"))


def built_index(docs: DataFrame, key: str, fields: list[str], tag: str | None = None) -> Index:
    """The index as stored tables: the documents are read and parted into terms once, whatever is asked of them later."""
    rows = written(postings(docs, key, fields, tag), "postings")
    lengths = rows.select("field", "doc", "dl").distinct()
    stats = written(lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "stats")
    return Index(rows, stats, written(rows.groupBy("field", "term").agg(F.count("*").alias("df")), "frequencies"))


_INDEXES: dict[tuple, Index] = {}


def kept_index(version: tuple, make: Callable[[], Index]) -> Index:
    """The index of a version of a table (its files and their times), built when it is first asked for."""
    if version not in _INDEXES:
        _INDEXES[version] = make()
    return _INDEXES[version]


def query_terms(queries: DataFrame, key: str, text: str, cfg: MatchConfig = CONFIG) -> DataFrame:
    """``query, term, n_terms``: the distinct terms of a query's first words (terms of no document count)."""
    words = F.slice(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+"), 1, cfg.query_words)
    terms = F.array_distinct(tokens(F.array_join(words, " ")))
    return queries.select(F.col(key).alias("query"), terms.alias("terms")).select("query", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))


def _hits(index: Index, terms: DataFrame, cfg: MatchConfig) -> DataFrame:
    """``query, n_terms, doc, field, part``: what each term of a query adds to a document's score in a field."""
    # all a term brings along is joined to it first, so that the postings, which are large but lie compact on disk, take part in
    # one join and stay where they are as long as the queries are few; else both are shuffled, and AQE splits a term of many postings
    asked = cut(terms.join(index.frequencies, "term").join(F.broadcast(index.stats), "field"))  # stats: a row a field
    side = F.broadcast(asked) if asked.count() <= SENT else asked.hint("merge")
    hits = index.postings.join(side, ["field", "term"])
    if "allow" in terms.columns:
        hits = hits.where(F.col("allow").isNull() | F.array_contains("allow", F.col("tag")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("dl") / F.col("avgdl"))
    return hits.select("query", "n_terms", "doc", "field", (idf * F.col("tf") / norm).alias("part"))


def _enough(msm: float) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(msm) * F.col("n_terms")))


def bm25(index: Index, terms: DataFrame, msm: float, cfg: MatchConfig = CONFIG) -> DataFrame:
    """``query, doc, field, score, matched``: BM25 per field of the documents with enough of the query's terms.

    Enough is the part ``msm`` of the query's terms, rounded down, at least one.
    With a column ``allow`` (an array of tags, null for all) in ``terms`` only
    documents with these tags are scored.
    """
    out = _hits(index, terms, cfg).groupBy("query", "doc", "field").agg(F.sum("part").alias("score"), F.count("*").alias("matched"), F.max("n_terms").alias("n_terms"))
    return out.where(F.col("matched") >= _enough(msm)).select("query", "doc", "field", "score", "matched")


def best_fields(index: Index, terms: DataFrame, boosts: Mapping[str, float], msm: float, cfg: MatchConfig = CONFIG) -> DataFrame:
    """``query, doc, score``: the greatest boosted score over the fields that have enough of the query's terms; see :func:`bm25`.

    The fields are columns of one aggregation, so that a pair of query and
    document is shuffled once, not once a field.
    """
    wanted = index._replace(postings=index.postings.where(F.col("field").isin(list(boosts))))
    own = lambda f: F.when(F.col("field") == f, F.col("part"))
    sums = [x for i, f in enumerate(boosts) for x in (F.sum(own(f)).alias(f"s{i}"), F.count(own(f)).cast("int").alias(f"m{i}"))]
    per = _hits(wanted, terms, cfg).groupBy("query", "n_terms", "doc").agg(*sums)
    each = [F.when(F.col(f"m{i}") >= _enough(msm), F.lit(float(b)) * F.col(f"s{i}")) for i, b in enumerate(boosts.values())]
    return per.select("query", "doc", (F.greatest(*each) if len(each) > 1 else each[0]).alias("score")).where("score is not null")


def top_k(scores: DataFrame, k: int, by: str = "query", item: str = "doc", places: int = 6) -> DataFrame:
    """The ``k`` best per ``by`` with ``rank`` from 1; scores are rounded, ties go to the lower item."""
    rounded = scores.withColumn("score", F.round("score", places))
    w = W.partitionBy(by).orderBy(F.desc("score"), F.col(item))
    return rounded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: Index, terms: DataFrame, boosts: Mapping[str, float], msm: float, k: int, cfg: MatchConfig = CONFIG) -> DataFrame:
    """``query, doc, score, rank`` by the best boosted field, of the fields that the index has."""
    return top_k(best_fields(index, terms, boosts, msm, cfg), k)


def _blocks(vectors: DataFrame, size: int, names: tuple[str, str, str]) -> DataFrame:
    """Vectors packed into blocks of up to ``size`` rows, in the order in which they lie in their partition."""
    ids, vecs, tags = names
    n = F.lit(size)
    numbered = vectors.withColumn("_b", F.floor(F.monotonically_increasing_id() / n))
    return numbered.groupBy("_b").agg(F.collect_list("id").alias(ids), F.collect_list("vec").alias(vecs), F.collect_list(F.struct("tag")).alias("_t")).drop("_b").withColumn(tags, F.col("_t.tag")).drop("_t")  # size rows at most


def nearest(queries: DataFrame, corpus: DataFrame, k: int, same_tag: bool = False, same_table: bool = True, allow: bool = False) -> DataFrame:
    """``query, doc, score, rank``: the exact ``k`` nearest by cosine, ``score = (1 + cosine) / 2``.

    Both tables hold ``id, vec, tag``; blocks of queries meet blocks of the
    corpus in one matrix product, and only the best of a block go on.  In the
    same table a vector is not its own neighbour.
    A null vector, or one with a null, is left out; a zero vector stands for a
    constant one.  ``same_tag``: only within equal tags (a filter before the
    search); ``allow``: a query's ``tag`` is the array of the tags it allows,
    null for all.
    """
    good = lambda d: d.where("vec is not null and size(vec) > 0 and not exists(vec, x -> x is null)")
    q, c = _blocks(good(queries), 256, ("q_ids", "q_vecs", "q_tags")), _blocks(good(corpus), 1024, ("c_ids", "c_vecs", "c_tags"))
    met = c.crossJoin(q)  # a stated query set against all rows, in blocks

    def unit(rows: list) -> np.ndarray:
        v = np.array([np.asarray(r, np.float64) for r in rows])
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.where(n < 1e-8, 1e-6, v)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                cos = unit(r.q_vecs) @ unit(r.c_vecs).T
                qi, ci = np.asarray(r.q_ids), np.asarray(r.c_ids)
                if same_table:
                    cos[qi[:, None] == ci[None, :]] = -np.inf
                if allow:
                    tags, at_tag = np.unique(np.asarray(r.c_tags), return_inverse=True)
                    fits = np.array([np.ones(len(tags), bool) if t is None else np.isin(tags, np.asarray(t)) for t in r.q_tags])
                    cos[~fits[:, at_tag]] = -np.inf
                if same_tag:
                    cos[np.asarray(r.q_tags)[:, None] != np.asarray(r.c_tags)[None, :]] = -np.inf
                m = min(k + 8, cos.shape[1])
                at = np.argpartition(-cos, m - 1, axis=1)[:, :m]
                val = np.take_along_axis(cos, at, 1)
                yield pd.DataFrame({"query": np.repeat(qi, m), "doc": ci[at].ravel(), "score": ((1 + val) / 2).ravel()})

    found = met.mapInPandas(best, "query bigint, doc bigint, score double").where("score >= 0")
    return top_k(found, k)


def nearest_by_hash(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, tables: int = 8, width: float = 1.0, seed: int = 5) -> DataFrame:
    """``query, doc, dist, rank``: the ``k`` nearest found by random projections, ``dist`` between vectors of length 1.

    Not exact: only vectors that share a bucket of one of ``tables`` projections
    meet.  Null and zero vectors are left out; all others are indexed.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    def unit(d: DataFrame) -> DataFrame:
        wide = F.transform(vector, lambda x: x.cast("double"))
        norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda t, x: t + x * x))
        d = d.where(F.col(vector).isNotNull()).select(key, wide.alias("w"), norm.alias("n")).where("n > 0")
        return d.select(key, array_to_vector(F.transform("w", lambda x: x / F.col("n"))).alias("features"))

    q, c = unit(queries), unit(corpus)
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(c)
    near = model.approxSimilarityJoin(q, c, 2.0, distCol="dist")  # no two vectors of length 1 are farther apart
    near = near.select(F.col(f"datasetA.{key}").alias("query"), F.col(f"datasetB.{key}").alias("doc"), "dist").where("query <> doc")
    w = W.partitionBy("query").orderBy("dist", "doc")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "doc", F.round("dist", 6).alias("dist"), "rank")


def fuse(lexical: DataFrame, vector: DataFrame, k: int, cfg: MatchConfig = CONFIG, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``query, doc, rrf_score, bm25_rank, knn_rank, rank, total``: reciprocal rank fusion of two ranked lists.

    Ties keep the lexical list's order first; ``total`` counts the fused list
    before it is cut at ``k``.
    """
    part = lambda d, w, own: d.select("query", "doc", (F.lit(w) / (cfg.rrf_k + F.col("rank"))).alias("s"), *[F.col("rank").alias(n) if n == own else F.lit(None).cast("int").alias(n) for n in ("bm25_rank", "knn_rank")])
    both = part(lexical, weights[0], "bm25_rank").unionByName(part(vector, weights[1], "knn_rank"))
    fused = both.groupBy("query", "doc").agg(F.round(F.sum("s"), 8).alias("rrf_score"), F.max("bm25_rank").alias("bm25_rank"), F.max("knn_rank").alias("knn_rank"))
    w = W.partitionBy("query")
    order = w.orderBy(F.desc("rrf_score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("knn_rank"), "doc")
    return fused.withColumns({"total": F.count("*").over(w), "rank": F.row_number().over(order)}).where(F.col("rank") <= k)


def short_lists(strict: DataFrame, queries: DataFrame, key: str, cfg: MatchConfig = CONFIG) -> DataFrame:
    """``query``: those with fewer hits than ``cfg.relax_below``, none included."""
    counts = queries.select(F.col(key).alias("query")).distinct().join(strict.groupBy("query").agg(F.count("*").alias("hits")), "query", "left")
    return counts.where(F.coalesce("hits", F.lit(0)) < cfg.relax_below).select("query")


def relaxed(strict: DataFrame, loose: DataFrame, few: DataFrame) -> DataFrame:
    """The strict list of each query, of those in ``few`` the loose one instead; ``is_relaxed`` tells which."""
    return strict.join(few, "query", "left_anti").withColumn("is_relaxed", F.lit(False)).unionByName(loose.join(few, "query", "left_semi").withColumn("is_relaxed", F.lit(True)))
