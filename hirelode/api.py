"""The library's entrances: tables in, tables out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .config import CONFIG, MatchConfig
from .functions import geo, records, salary
from .functions.columns import evaluated
from .functions.dialect import SPARK, column
from .operators import encoding, ingest, matching, retrieval, scoring
from .sources.tables import cut

SEARCHED = ["title", "technical_skills", "certificates", "languages", "soft_skills", "job_requirements", "job_description"]


def page_bounds(page: int | None, size: int | None, cfg: MatchConfig = CONFIG) -> tuple[int, int]:
    """Offset and size of a page: pages count from 1, a missing or zero size is the usual one, others lie between 1 and the most."""
    n = min(max(int(size or cfg.page_size), 1), cfg.page_size_most)
    return (max(int(page or 1), 1) - 1) * n, n


def browse(jobs: DataFrame, q: str | None = None, page: int | None = 1, size: int | None = None, index: retrieval.Index | None = None, cfg: MatchConfig = CONFIG) -> DataFrame:
    """A page of adverts: by the words of ``q``, best first, or the last crawled first; ties by ``job_id``."""
    offset, n = page_bounds(page, size, cfg)
    if q and q.strip():
        fields = {f: b for f, b in cfg.browse_boosts.items() if f in jobs.columns and f != "category"}
        index = index or retrieval.built_index(jobs, "job_id", list(fields))
        asked = jobs.sparkSession.createDataFrame([(1, q)], "query int, txt string")
        hits = retrieval.search(index, retrieval.query_terms(asked, "query", "txt"), fields, 0.0, offset + n).where(F.col("rank") > offset)
        return jobs.join(hits.select(F.col("doc").alias("job_id"), "rank", "score"), "job_id").orderBy("rank")
    seen = F.try_to_timestamp(F.col("crawled_date"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return jobs.orderBy(F.desc_nulls_last(seen), "job_id").offset(offset).limit(n)


def shuffled(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """``n`` rows in a shuffled order that repeats with the seed, with ``place`` from 1; only they are brought into one task."""
    by = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    few = df.withColumn("_by", by).orderBy("_by", key).limit(n)
    return few.withColumn("place", F.row_number().over(W.orderBy("_by", key))).drop("_by")


def score_pairs(pairs: DataFrame, cv: Mapping[str, str] | None = None, job: Mapping[str, str] | None = None, weights: Mapping[str, float] | None = None) -> DataFrame:
    """``query, doc``, the six scores and ``total`` of pairs with the columns that ``matching.rubric`` names."""
    from .plans.matching import CV_SIDE, JOB_SIDE

    sc = matching.rubric(SPARK, dict(cv or CV_SIDE), dict(job or JOB_SIDE))
    d = pairs.select("query", "doc", *[column(f"CAST({x} AS double)").alias(k) for k, x in sc.items()])
    w = weights or CONFIG.weights
    return d.withColumn("total", F.round(sum((F.col(k) * F.lit(float(w.get(k, 0.0))) for k in sc), F.lit(0.0)), 2))


def location_score(pairs: DataFrame, detailed: bool = False, cfg: MatchConfig = CONFIG) -> DataFrame:
    """``query, doc, km, score``: by cities (``cv_cities``, ``job_cities``), or ``detailed`` by the nearest branch; see ``matching.nearest_branch``."""
    by_city = column(geo.city_score(SPARK, "cv_cities", "job_cities", cfg.same_city, cfg.other_city, cfg.unknown_city))
    if detailed:
        return matching.nearest_branch(pairs.withColumn("city_score", by_city), cfg)
    return pairs.select("query", "doc", F.lit(None).cast("double").alias("km"), by_city.alias("score"))


def match(cvs: DataFrame, jobs: DataFrame, cities: DataFrame, encoder: encoding.Encoder | None = None, cfg: MatchConfig = CONFIG) -> DataFrame:
    """``query, doc, place, match_score, position``: the adverts of each profile, retrieved by words and vectors, scored and ranked.

    Adverts that are expired or not open to the profile's gender are left out,
    and those outside the categories it suggests, unless they bring fewer hits
    than ``cfg.relax_below``.  A profile without skills gets no row.
    """
    from .plans.matching import _cv_cols, job_columns

    encoder = encoder or encoding.HashingEncoder()
    fields = {f: b for f, b in cfg.boosts.items() if f in jobs.columns}
    kinds = jobs.select("category", "gender_requirement", F.coalesce("is_expired", F.lit(False)).alias("gone")).distinct().limit(10_001).collect()
    if len(kinds) > 10_000:
        raise ValueError("too many combinations of filtered values")
    spark = jobs.sparkSession
    tags = spark.createDataFrame([(i, *k) for i, k in enumerate(sorted(map(tuple, kinds), key=repr))], "tag int, category string, gender_requirement string, gone boolean")
    same = F.col("j.category").eqNullSafe(F.col("t.category")) & F.col("j.gender_requirement").eqNullSafe(F.col("t.gender_requirement")) & (F.coalesce("j.is_expired", F.lit(False)) == F.col("t.gone"))
    tagged = jobs.alias("j").join(F.broadcast(tags).alias("t"), same).select("j.*", "t.tag")  # 10,000 rows at most
    index = retrieval.built_index(tagged, "job_id", list(fields), "tag")
    asks = cvs.where(F.trim("skills") != "")
    extras = [F.col(c) for c in ("soft_skills", "languages", "certificates", "education", "experience")]
    asks = asks.withColumn("_text", encoding.retrieval_text(F.col("skills"), extras, F.col("suggested_categories")))
    terms = cut(retrieval.query_terms(asks, "cv_id", "_text", cfg))
    q_vec = cut(encoding.encoded(asks.withColumn("_t", encoding.cv_text(F.col("_text"), F.col("cv_markdown"))), "cv_id", "_t", encoder))
    none = F.lit(None).cast("string")
    body = encoding.job_text(F.col("title"), none, F.col("technical_skills"), none, F.col("job_requirements"))
    c_vec = encoding.encoded(tagged.withColumn("_t", body), "job_id", "_t", encoder).join(tagged.select(F.col("job_id").alias("id"), F.col("tag").alias("_tag")), "id").select("id", "vec", F.col("_tag").alias("tag"))
    c_vec = cut(c_vec)
    numbers = cut(q_vec.select("id").distinct().select("id", F.xxhash64("id").alias("no")))

    def fused(wanted: bool, msm: float, only: DataFrame | None = None) -> DataFrame:
        fits = ~F.col("t.gone") & column(records.allowed_gender(SPARK, "c.gender", "t.gender_requirement"))
        if wanted:
            named = F.filter("c.suggested_categories", lambda x: x.isNotNull())
            fits = fits & (F.col("c.suggested_categories").isNull() | (F.size(named) == 0) | F.coalesce(F.array_contains(named, F.col("t.category")), F.lit(False)))
        allow = asks.alias("c").join(F.broadcast(tags).alias("t"), fits, "left").groupBy(F.col("c.cv_id").alias("query")).agg(F.collect_set("t.tag").alias("allow"))
        allow = cut(allow if only is None else allow.join(only, "query", "left_semi"))
        lexical = retrieval.search(index, terms.join(allow, "query"), fields, msm, cfg.size, cfg)
        q = q_vec.drop("tag").join(numbers, "id").join(allow.withColumnRenamed("query", "id"), "id").select(F.col("no").alias("id"), "vec", F.col("allow").alias("tag"))
        near = retrieval.nearest(q, c_vec, cfg.size, same_table=False, allow=True).withColumnRenamed("query", "no").join(numbers.withColumnRenamed("id", "query"), "no")
        return retrieval.fuse(lexical, near.select("query", "doc", "score", "rank"), cfg.size, cfg).select("query", "doc", "rank")

    hits = cut(fused(True, cfg.msm))
    few = cut(retrieval.short_lists(hits, cvs, "cv_id", cfg))
    if not few.isEmpty():
        hits = cut(retrieval.relaxed(hits, fused(False, cfg.msm_relaxed, few), few).drop("is_relaxed"))
    cv = cvs.withColumnRenamed("cv_id", "query")
    cv_side = cv.select("query", *[column(x).alias(n) for n, x in _cv_cols(SPARK).items()]).join(matching.city_sets(cv, "query", "cv_location", cities, "ref_id", "city").withColumnRenamed("cities", "cv_cities"), "query")
    found = jobs.withColumnRenamed("job_id", "doc").join(hits.select("doc").distinct(), "doc", "left_semi")
    job_side = job_columns(found, "doc").join(matching.city_sets(found, "doc", "job_location", cities, "ref_id", "city").withColumnRenamed("cities", "job_cities"), "doc")
    pairs = cut(hits.join(cv_side, "query").join(job_side, "doc"))
    total = score_pairs(pairs).select("query", "doc", "total")
    same_city = F.coalesce(F.arrays_overlap("cv_cities", "job_cities"), F.lit(False))
    placed = pairs.select("query", "doc", "rank", same_city.alias("same_city")).join(total, ["query", "doc"])
    placed = placed.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("same_city"), "rank")))
    return matching.ranked(placed, "total", cfg)


def clean(raw: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Clean records of crawled ones: sections and overview by patterns, pay, city, gender, schooling and commission repaired.

    ``parsed``: what a model read from a record, by ``url``, in the columns of
    clean records; without it those fields are empty.
    """
    fields = ["job_salary", "salary_note", "job_location", "education_level", "education_field", "technical_skills", "soft_skills", "languages", "certificates", "gender_requirement"]
    numbers = ["salary_min", "salary_max"]
    d = raw.join(parsed.select("url", *[c for c in (*fields, *numbers, "has_commission") if c in parsed.columns]), "url", "left") if parsed is not None else raw
    for c in (*fields, *numbers, "has_commission"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("double" if c in numbers else "boolean" if c == "has_commission" else "string"))
    d = d.select("*", *[column(records.section(SPARK, "job_details", h)).alias(n) for n, h in records.SECTIONS.items()])
    d = d.withColumns({"experience": column(records.overview_experience(SPARK, "overview")), "requirements_tags": column(records.requirement_tags(SPARK, "overview")), "specializations": column(records.specialisations(SPARK, "overview"))})
    d = evaluated(d, {"_in_pay": column(salary.stated_millions(SPARK, "job_salary")), "_in_title": column(salary.stated_millions(SPARK, "title"))})
    stated = "(CASE WHEN size(_in_pay) > 0 THEN _in_pay ELSE _in_title END)"
    fixed = {n: column(salary.repaired(SPARK, stated, "salary_min", "salary_max", upper)) for n, upper in (("salary_min", False), ("salary_max", True))}
    fixed |= {
        "job_location": column(geo.company_city(SPARK, "company_address", "job_location")),
        "gender_requirement": column(records.gender(SPARK, "title", "gender_requirement", "job_requirements")),
        "education_level": column(records.education(SPARK, "education_level")),
        "has_commission": column(records.commission(SPARK, "has_commission", "job_benefits", "salary_note", "job_description")),
    }
    return d.withColumns(fixed).drop("_in_pay", "_in_title")


#: Text fields of an index document, and its flags.
DOCUMENT_TEXT = "title url company company_address company_size company_field category deadline crawled_date requirements_tags specializations technical_skills soft_skills languages certificates job_description job_requirements job_benefits job_location working_time job_salary gender_requirement experience education_level education_field salary_note content_hash".split()
DOCUMENT_FLAGS = ("is_expired", "has_commission")


def build_jobs(clean_jobs: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Index documents of clean records, the last of each key: texts sanitised, pay in millions, points of the record or of the cache.

    ``points``: ``company_address, lat, lng``; an address under five letters is
    not looked up.  A missing column is empty.
    """
    have = set(clean_jobs.columns)
    col = lambda c, kind="string": F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    order = F.struct(col("crawled_date").alias("a"), col("content_hash").alias("b"))
    d = clean_jobs.withColumn("_key", F.md5(F.coalesce(column(records.canonical_url(SPARK, "url")), F.lit(""))))
    d = d.groupBy("_key").agg(F.max_by(F.struct(*clean_jobs.columns), order).alias("r")).select("_key", "r.*")
    kind = salary.kind(SPARK, "job_salary")
    pay = {"salary_min": salary.bound(SPARK, "job_salary", kind, False), "salary_max": salary.bound(SPARK, "job_salary", kind, True)}
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    out = d.select(
        F.col("_key").alias("doc_key"),
        *[F.when(F.lower(F.trim(col(c))) == "nan", "").otherwise(F.trim(F.coalesce(col(c), F.lit("")))).alias(c) for c in DOCUMENT_TEXT],
        *[column(records.boolean(SPARK, c)).alias(c) if c in have else F.lit(False).alias(c) for c in DOCUMENT_FLAGS],
        *[F.coalesce(finite(column(records.millions(SPARK, c))) if c in have else F.lit(None).cast("double"), column(x) / 1_000_000).alias(c) for c, x in pay.items()],
        F.coalesce(F.nullif(F.trim(col("salary_type")), F.lit("")), column(kind)).alias("salary_type"),
        finite(col("latitude", "double")).alias("_lat"),
        finite(col("longitude", "double")).alias("_lng"),
    )
    if points is not None:
        one = points.where("lat is not null and lng is not null").groupBy("company_address").agg(F.min(F.struct("lat", "lng")).alias("_p"))
        out = out.join(one.where(F.length("company_address") >= 5), "company_address", "left")
    else:
        out = out.withColumn("_p", F.lit(None).cast("struct<lat:double,lng:double>"))
    lat, lng = F.col("_lat"), F.col("_lng")
    point = F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng"))).otherwise(F.col("_p"))
    address = F.substring("company_address", 1, 100)
    points_of = F.when(point.isNotNull(), F.array(F.struct(point["lat"].alias("lat"), point["lng"].alias("lng"), address.alias("address")))).otherwise(F.array().cast("array<struct<lat:double,lng:double,address:string>>"))
    return out.withColumn("geo_coordinates", points_of).drop("_lat", "_lng", "_p")


def parse_cv(texts: DataFrame, key: str, text: str, parsers: Sequence[Callable[[str], Mapping[str, str] | None]]) -> DataFrame:
    return scoring.parsed_profiles(texts, key, text, parsers)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, digest: str, touched: str, as_of: Column) -> DataFrame:
    return ingest.merged(existing, incoming, key, digest, touched, as_of)
