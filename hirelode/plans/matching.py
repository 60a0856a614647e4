"""Retrieval, fusion, scoring and the whole match, with the SQL that checks them."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import CONFIG
from ..functions import geo, records, salary
from ..functions.columns import evaluated
from ..functions.dialect import CHECK, SPARK, Spark, column, fold
from ..operators import matching as m
from ..operators import retrieval as r
from ..operators.encoding import retrieval_text
from ..sources.tables import cut, table, version

AS_OF = "2026-03-01"
LEXICAL = {f: b for f, b in CONFIG.boosts.items() if f not in ("requirements_tags", "specializations")}
BROWSE = {f: b for f, b in CONFIG.browse_boosts.items() if f not in ("requirements_tags", "specializations")}
BROWSE_TEXT = "kế toán tổng hợp Hà Nội"


def _jobs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "jobs")


def _cvs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "cv_profiles")


# ------------------------------------------------------------------ SQL parts
def _index_sql(fields: list[str]) -> str:
    raw = " union all ".join(f"select job_id as doc, '{f}' as field, {f} as txt from jobs" for f in fields)
    return rf"""raw as ({raw}),
tk as (select field, doc, unnest(regexp_extract_all(lower(coalesce(txt, '')), '([\p{{L}}\p{{N}}]+)', 1)) as term from raw),
idx as (select field, doc, term, count(*) as tf from tk group by 1, 2, 3),
dls as (select field, doc, count(*) as dl from tk group by 1, 2),
st as (select field, count(*) as n, avg(dl) as avgdl from dls group by 1),
dfs as (select field, term, count(*) as df from idx group by 1, 2)"""


def _terms_sql(source: str) -> str:
    return rf"""q0 as (select query, list_distinct(regexp_extract_all(lower(array_to_string(list_slice(regexp_split_to_array(trim(coalesce(txt, '')), '\s+'), 1, {CONFIG.query_words}), ' ')), '([\p{{L}}\p{{N}}]+)', 1)) as terms from ({source})),
qt as (select query, len(terms) as n_terms, unnest(terms) as term from q0)"""


_CV_TEXT = "select cv_id as query, skills as txt from cv_profiles"
_SCORE = f"""per_field as materialized (
  select query, doc, field, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf / (tf + {CONFIG.k1}::double * (1 - {CONFIG.b}::double + {CONFIG.b}::double * dl / avgdl))) as score, count(*) as matched, max(n_terms) as n_terms
  from qt join idx using (term) join dfs using (field, term) join dls using (field, doc) join st using (field) group by 1, 2, 3)"""


def _enough(msm: float) -> str:
    return f"matched >= greatest(1, floor({msm}::double * n_terms))"


def _boosted(boosts: dict[str, float], msm: float, where: str = "true") -> str:
    case = "case field " + " ".join(f"when '{f}' then {b}::double" for f, b in boosts.items()) + " end"
    return f"(select query, doc, max({case} * score) as score from per_field where {_enough(msm)} and {where} group by 1, 2)"


def _topk(inner: str, k: int, cols: str = "query, doc, score, rank") -> str:
    return f"select {cols} from (select query, doc, round(score, 6) as score, row_number() over (partition by query order by round(score, 6) desc, doc) as rank from {inner}) where rank <= {k}"


# ------------------------------------------------------------------ retrieval
#: What a search may filter by; a combination of values is a tag of the index.
FILTERED = ["category", "gender_requirement", "is_expired"]
MAX_TAGS = 10_000


def _tags(s: SparkSession, d: str) -> DataFrame:
    """``tag`` and the values of each combination of the filtered fields; more than :data:`MAX_TAGS` raise ``ValueError``."""
    kinds = _jobs(s, d).select(*FILTERED).distinct().limit(MAX_TAGS + 1).collect()
    if len(kinds) > MAX_TAGS:
        raise ValueError("too many combinations of filtered values")
    rows = [(i, *r) for i, r in enumerate(sorted(map(tuple, kinds), key=repr))]
    return s.createDataFrame(rows, "tag int, category string, gender_requirement string, is_expired boolean")


def _tagged(s: SparkSession, d: str) -> DataFrame:
    tags = F.broadcast(_tags(s, d))  # at most MAX_TAGS rows
    same = None
    jobs = _jobs(s, d)
    for c in FILTERED:
        one = jobs[c].eqNullSafe(tags[c])
        same = one if same is None else same & one
    return jobs.join(tags, same, "left").select(jobs["*"], tags["tag"])


def _index(s: SparkSession, d: str, fields: list[str]) -> r.Index:
    return r.kept_index((tuple(fields), *version(_jobs(s, d))), lambda: r.built_index(_tagged(s, d), "job_id", fields, "tag"))


def _every_index(s: SparkSession, d: str) -> r.Index:
    """One index serves all searches: statistics are by field."""
    return _index(s, d, sorted({*LEXICAL, *BROWSE} - {"category"}))  # a keyword field matches as a whole only


def _allowed(s: SparkSession, d: str, wanted: bool, gender: bool) -> DataFrame:
    """``query, allow``: the tags a profile may be shown: not expired, open to its gender, of a category it suggests (all where it suggests none)."""
    q = _cvs(s, d).select("cv_id", F.col("gender").alias("g"), "suggested_categories")
    fits = ~F.coalesce(F.col("j.is_expired"), F.lit(False))
    if gender:
        fits = fits & column(records.allowed_gender(SPARK, "c.g", "j.gender_requirement"))
    if wanted:
        named = F.filter("c.suggested_categories", lambda x: x.isNotNull())
        fits = fits & (F.col("c.suggested_categories").isNull() | (F.size(named) == 0) | F.coalesce(F.array_contains(named, F.col("j.category")), F.lit(False)))
    pairs = q.alias("c").join(F.broadcast(_tags(s, d)).alias("j"), fits, "left")  # at most MAX_TAGS rows
    return pairs.groupBy(F.col("c.cv_id").alias("query")).agg(F.sort_array(F.collect_set("j.tag")).alias("allow"))


def tokenize_stats(s: SparkSession, d: str) -> DataFrame:
    idx = r.postings(_jobs(s, d), "job_id", ["title", "technical_skills"])
    return idx.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return r.search(_every_index(s, d), r.query_terms(_cvs(s, d), "cv_id", "skills"), {"technical_skills": 1.0}, 0.0, 10).select("query", "doc", "score", "rank")


def bm25_msm(s: SparkSession, d: str) -> DataFrame:
    idx = _every_index(s, d)
    two = idx._replace(postings=idx.postings.where("field in ('technical_skills', 'job_requirements')"))
    per = r.bm25(two, r.query_terms(_cvs(s, d), "cv_id", "skills"), CONFIG.msm)
    return per.groupBy("field", "matched").agg(F.count("*").alias("n_pairs"), F.round(F.max("score"), 6).alias("best"))


def _lexical(s: SparkSession, d: str, msm: float, k: int, allow: DataFrame | None = None, full: bool = False) -> DataFrame:
    """By the skills of a profile, or by all it says (``full``)."""
    cv = _cvs(s, d)
    if full:
        extras = [F.col(c) for c in ("soft_skills", "languages", "certificates", "education", "experience")]
        cv = cv.where(F.trim("skills") != "").withColumn("_text", retrieval_text(F.col("skills"), extras, F.col("suggested_categories")))
    terms = r.query_terms(cv, "cv_id", "_text" if full else "skills")
    if allow is not None:
        terms = terms.join(allow, "query")
    return r.search(_every_index(s, d), terms, LEXICAL, msm, k)


def multi_match_best_fields(s: SparkSession, d: str) -> DataFrame:
    return _lexical(s, d, CONFIG.msm, 10).select("query", "doc", "score", "rank")


def browse_search(s: SparkSession, d: str) -> DataFrame:
    q = s.createDataFrame([(1, BROWSE_TEXT)], "query int, txt string")
    fields = {f: b for f, b in BROWSE.items() if f != "category"}
    return r.search(_every_index(s, d), r.query_terms(q, "query", "txt"), fields, 0.0, 20).select("doc", "score", "rank")


def browse_page(s: SparkSession, d: str) -> DataFrame:
    page, size = 3, 20
    seen = F.try_to_timestamp(F.col("crawled_date"), F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = _jobs(s, d).select("job_id", "title", seen.alias("seen"))
    return rows.orderBy(F.desc_nulls_last("seen"), "job_id").offset((page - 1) * size).limit(size).select("job_id", "title")


def filter_category(s: SparkSession, d: str) -> DataFrame:
    return _jobs(s, d).where(F.col("category").isin("IT", "Marketing")).select("job_id", "category")


def _open_pairs(q: Spark) -> str:
    return records.allowed_gender(q, "c.gender", "j.gender_requirement")


def filter_gender(s: SparkSession, d: str) -> DataFrame:
    """For every gender a profile states, the adverts open to it, counted by what they ask for."""
    cv = _cvs(s, d).select("gender").distinct().alias("c")  # a handful of codes
    asks = _jobs(s, d).groupBy("gender_requirement").agg(F.count("*").alias("n_jobs")).alias("j")
    return asks.join(F.broadcast(cv), column(_open_pairs(SPARK))).select("gender", "gender_requirement", "n_jobs")


def filter_not_expired(s: SparkSession, d: str) -> DataFrame:
    return _jobs(s, d).where(~F.coalesce("is_expired", F.lit(False))).select("job_id")


def knn_topk(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("tag"))
    return r.nearest(v.where("id % 100 = 0"), v, 10).select("query", "doc", "score", "rank")


def knn_prefiltered(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("tag"))
    return r.nearest(v.where("id % 100 = 0"), v, 10, same_tag=True).select("query", "doc", "score", "rank")


def _vector_list(s: SparkSession, d: str, k: int, allow: DataFrame | None = None) -> DataFrame:
    """A profile's and an advert's vector are those of the vector table by number, as that has no texts; ``semantic_match`` encodes texts."""
    vec = table(s, d, "embeddings").select("vec_id", "embedding")
    n = vec.agg(F.count("*").alias("n"))
    numbered = _cvs(s, d).select("cv_id", F.row_number().over(W.orderBy("cv_id")).cast("bigint").alias("no"))  # profiles are a fixed short list
    at = lambda df, i: df.crossJoin(F.broadcast(n)).withColumn("vec_id", F.pmod(F.col(i), F.col("n"))).join(vec, "vec_id")  # noqa: E731  n: one row
    asks = numbered if allow is None else numbered.join(allow.withColumnRenamed("query", "cv_id"), "cv_id")
    tag = F.lit(0) if allow is None else F.col("allow")
    q = at(asks, "no").select(F.col("no").alias("id"), F.col("embedding").alias("vec"), tag.alias("tag"))
    jobs = _jobs(s, d).select("job_id", F.lit(0).alias("tag")) if allow is None else _tagged(s, d).select("job_id", "tag")
    c = at(jobs, "job_id").select(F.col("job_id").alias("id"), F.col("embedding").alias("vec"), "tag")
    near = r.nearest(q, c, k, same_table=False, allow=allow is not None)
    return near.withColumnRenamed("query", "no").join(F.broadcast(numbered), "no").select(F.col("cv_id").alias("query"), "doc", "score", "rank")


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    fused = r.fuse(_lexical(s, d, CONFIG.msm, 20), _vector_list(s, d, 20), 20)
    return fused.select("query", "doc", "rrf_score", "bm25_rank", "knn_rank", "rank")


def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    allow = _allowed(s, d, wanted=False, gender=False)
    fused = r.fuse(_lexical(s, d, CONFIG.msm, CONFIG.size, allow), _vector_list(s, d, CONFIG.size, allow), CONFIG.size)
    return fused.select("query", "doc", "rrf_score", "rank", "total")


def hybrid_relaxed(s: SparkSession, d: str) -> DataFrame:
    """Of all profiles: both lists within the categories a profile suggests; where they bring few hits, more loosely and without that filter."""
    strict = cut(_fused(s, d, CONFIG.msm, _allowed(s, d, wanted=True, gender=True)))
    few = cut(r.short_lists(strict, _cvs(s, d), "cv_id"))
    if few.isEmpty():
        return strict.withColumn("is_relaxed", F.lit(False))
    loose = _fused(s, d, CONFIG.msm_relaxed, _allowed(s, d, wanted=False, gender=True).join(few, "query", "left_semi"))
    return r.relaxed(strict, loose, few)


def _fused(s: SparkSession, d: str, msm: float, allow: DataFrame) -> DataFrame:
    """Both lists of the profiles in ``allow``, fused."""
    allow = cut(allow)
    return r.fuse(_lexical(s, d, msm, CONFIG.size, allow, full=True), _vector_list(s, d, CONFIG.size, allow), CONFIG.size).select("query", "doc", "rrf_score", "rank")


# ------------------------------------------------------------------ places


def _norm_sql(x: str) -> str:
    bare = CHECK.repl(fold(CHECK, f"coalesce({x}, '')"), r"\p{M}")
    return f"(' ' || trim({CHECK.repl(bare, '[^a-z0-9]+', ' ')}) || ' ')"


_ALIASES = ", ".join(f"({CHECK.lit(c)}, '{a}')" for c, names in m.CITY_ALIASES.items() for a in names)


def _cities_sql(name: str, source: str, key: str, place: str) -> str:
    norm = _norm_sql(place)
    return f"""{name}_names as (
  select ref_id, trim({_norm_sql('city')}) as n from city_ref union select ref_id, a.alias from city_ref join (values {_ALIASES}) as a(city, alias) using (city)),
{name}_met as (
  select {key}, ref_id, trim(substr(t, 1, strpos(t, ' ' || n || ' '))) as pre, trim(substr(t, strpos(t, ' ' || n || ' ') + length(n) + 1)) as post
  from (select {key}, {norm} as t from {source} where {key} is not null) join {name}_names on contains(t, ' ' || n || ' ')),
{name}_good as (
  select distinct {key}, ref_id from {name}_met
  where not regexp_matches(right(pre, 20), '(phuong|quan|duong|pho|thon|ap|xa|huyen|thi tran|khu pho|to|ngo|hem)$') and not regexp_matches(left(post, 20), '^(phu|plaza|tower|building|center|centre|street|road|avenue)')),
{name} as (
  select a.{key}, coalesce(list(c.ref_id order by c.ref_id) filter (where c.ref_id is not null), []::int[]) as cities
  from (select distinct {key} from {source} where {key} is not null) a left join {name}_good c using ({key}) group by 1)"""


def gazetteer_match(s: SparkSession, d: str) -> DataFrame:
    sets = m.city_sets(_jobs(s, d), "job_id", "job_location", table(s, d, "city_ref"), "ref_id", "city")
    return sets.select("job_id", F.explode("cities").alias("ref_id"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """The retrieved pairs with their columns for scoring."""
    hits = _lexical(s, d, CONFIG.msm, CONFIG.size).select("query", "doc", "rank")
    return _with_columns(s, d, hits)


def _cv_cols(q: Spark) -> dict[str, str]:
    low = q.distinct(q.map(records.listed(q, "skills"), "p", "lower(p)"))
    return {"cv_skills": low, "cv_wanted": "suggested_categories", "cv_experience": "experience", "cv_education": "education", "cv_salary": "salary"}


def _job_cols(q: Spark, kind: str | None = None) -> dict[str, str]:
    """Of an advert; ``kind`` names a column that holds the kind of its pay."""
    kind = kind or salary.kind(q, "job_salary")
    low = q.distinct(q.map(records.listed(q, "technical_skills"), "p", "lower(p)"))
    return {
        "job_skills": low,
        "job_category": "category",
        "job_experience": "experience",
        "job_education": records.education(q, "education_level"),
        "pay_kind": kind,
        "pay_min": salary.bound(q, "job_salary", kind, False),
        "pay_max": salary.bound(q, "job_salary", kind, True),
    }


CV_SIDE = {k: f"cv_{k}" for k in ("skills", "wanted", "experience", "education", "salary", "cities")}
JOB_SIDE = {k: f"job_{k}" for k in ("skills", "category", "experience", "education", "cities")} | {k: k for k in ("pay_kind", "pay_min", "pay_max")}


def job_columns(jobs: DataFrame, key: str) -> DataFrame:
    """``key`` and the columns of :func:`_job_cols`, the kind of pay read once."""
    d = evaluated(jobs, {"_kind": column(salary.kind(SPARK, "job_salary"))})
    return d.select(key, *[column(x).alias(n) for n, x in _job_cols(SPARK, "_kind").items()])


def _with_columns(s: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    ref = table(s, d, "city_ref")
    hits = cut(hits)
    cv = _cvs(s, d).select(F.col("cv_id").alias("query"), *[column(x).alias(n) for n, x in _cv_cols(SPARK).items()])
    cv = cv.join(m.city_sets(_cvs(s, d).withColumnRenamed("cv_id", "query"), "query", "cv_location", ref, "ref_id", "city").withColumnRenamed("cities", "cv_cities"), "query")
    # only adverts that were hit are parsed
    found = _jobs(s, d).withColumnRenamed("job_id", "doc").join(hits.select("doc").distinct(), "doc", "left_semi")
    job = job_columns(found, "doc")
    job = job.join(m.city_sets(found, "doc", "job_location", ref, "ref_id", "city").withColumnRenamed("cities", "job_cities"), "doc")
    return hits.join(cv, "query").join(job, "doc")


def city_score(s: SparkSession, d: str) -> DataFrame:
    score = geo.city_score(SPARK, "cv_cities", "job_cities", CONFIG.same_city, CONFIG.other_city, CONFIG.unknown_city)
    return _pairs(s, d).select("query", "doc", column(score).alias("score"))


def distance_score(s: SparkSession, d: str) -> DataFrame:
    """Between an advert's point and the cached point of its address."""
    j = _jobs(s, d).select("job_id", "company_address", F.col("latitude").alias("a"), F.col("longitude").alias("b")).where("a is not null and b is not null")
    g = table(s, d, "geocode_cache").where("lat is not null and lng is not null").groupBy("company_address").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    km = geo.distance_km("a", "b", "lat", "lng")
    return j.join(g, "company_address").select("job_id", column(f"round({km}, 3)").alias("km"), column(geo.distance_score(km, CONFIG.distance_km, CONFIG.location_floor)).alias("score"))


def same_city_partition(s: SparkSession, d: str) -> DataFrame:
    ref = table(s, d, "city_ref")
    hits = _lexical(s, d, CONFIG.msm, 20).select("query", "doc", "rank")
    cv = m.city_sets(_cvs(s, d).withColumnRenamed("cv_id", "query"), "query", "cv_location", ref, "ref_id", "city")
    job = m.city_sets(_jobs(s, d).withColumnRenamed("job_id", "doc"), "doc", "job_location", ref, "ref_id", "city")
    return m.same_city_first(hits, cv, job).select("query", "doc", "rank", "same_city", "place")


def _scores(q: Spark) -> dict[str, str]:
    return m.rubric(q, CV_SIDE, JOB_SIDE)


def rubric_scores(s: SparkSession, d: str) -> DataFrame:
    sc = _scores(SPARK)
    return _pairs(s, d).select("query", "doc", *[column(f"CAST({x} AS double)").alias(k) for k, x in sc.items()])


def wsm_total(s: SparkSession, d: str) -> DataFrame:
    pairs = rubric_scores(s, d)
    return pairs.select("query", "doc", column(m.weighted({k: k for k in CONFIG.weights})).alias("total"))


def fallback_score(s: SparkSession, d: str) -> DataFrame:
    hits = _lexical(s, d, CONFIG.msm, CONFIG.size)
    return hits.select("query", "doc", column(m.fallback("(rank - 1)")).alias("score"))


def head_tail_rank(s: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(s, d)
    w = pairs.withColumn("place", F.col("rank")).withColumn("total", column(m.weighted(_scores(SPARK))))
    return m.ranked(w, "total")


def match_pipeline(s: SparkSession, d: str) -> DataFrame:
    """Retrieve and fuse, more loosely where that brings few; put the profile's city first, score the head, rank."""
    pairs = _with_columns(s, d, hybrid_relaxed(s, d).select("query", "doc", "rank"))
    first = pairs.withColumn("same_city", F.coalesce(F.arrays_overlap("cv_cities", "job_cities"), F.lit(False)))
    placed = first.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("same_city"), "rank")))
    return m.ranked(placed.withColumn("total", column(m.weighted(_scores(SPARK)))), "total")


QUERIES = {
    f.__name__: f
    for f in (
        match_pipeline, tokenize_stats, bm25_topk, bm25_msm, multi_match_best_fields, browse_search, browse_page, filter_category, filter_gender, filter_not_expired,
        knn_topk, knn_prefiltered, rrf_fusion, hybrid_search, hybrid_relaxed, gazetteer_match, city_score, distance_score, same_city_partition, rubric_scores,
        wsm_total, fallback_score, head_tail_rank,
    )
}

# ------------------------------------------------------------------ SQL
_LEX = f"with {_index_sql(list(LEXICAL))},\n{_terms_sql(_CV_TEXT)},\n{_SCORE}"
_OPEN = "doc in (select job_id from jobs where not coalesce(is_expired, false))"
_FULL_TEXT = "select cv_id as query, concat_ws(', ', nullif(trim(skills), ''), nullif(trim(soft_skills), ''), nullif(trim(languages), ''), nullif(trim(certificates), ''), nullif(trim(education), ''), nullif(trim(experience), ''), nullif(array_to_string(suggested_categories, ', '), '')) as txt from cv_profiles where trim(skills) <> ''"


def _relaxed_sql() -> str:
    """Both passes written out, with the filters as pairs of profile and advert."""
    gender = _open_pairs(CHECK)
    category = "(c.suggested_categories is null or len(list_filter(c.suggested_categories, lambda x: x is not null)) = 0 or coalesce(list_contains(list_filter(c.suggested_categories, lambda x: x is not null), j.category), false))"
    parts = [f"""{_index_sql(list(LEXICAL))},
{_terms_sql(_FULL_TEXT)},
{_SCORE},
{_NUMBERED},
qv as materialized (select cvn.cv_id as query, embedding::double[] as v from cvn cross join nv join embeddings on vec_id = no % n),
jv as materialized (select job_id as doc, embedding::double[] as v from jobs cross join nv join embeddings on vec_id = job_id % n)"""]
    for tag, msm, filters in (("s", CONFIG.msm, f"{gender} and {category}"), ("l", CONFIG.msm_relaxed, gender)):
        parts.append(f"""ok_{tag} as materialized (select c.cv_id as query, j.job_id as doc from cv_profiles c join jobs j on not coalesce(j.is_expired, false) and {filters}),
lex_{tag} as ({_topk(_boosted(LEXICAL, msm, f'(query, doc) in (select query, doc from ok_{tag})'), CONFIG.size)}),
vec_{tag} as (
  select query, doc, row_number() over (partition by query order by score desc, doc) as rank from (
    select o.query, o.doc, round((1 + list_cosine_similarity(qe.v, je.v)) / 2, 6) as score
    from ok_{tag} o join qv qe using (query) join jv je using (doc))
  qualify rank <= {CONFIG.size}),
both_{tag} as materialized (
  select query, doc, round(sum(s), 8) as rrf_score, max(b) as b, max(v) as v from (
    select query, doc, 1.0::double / ({CONFIG.rrf_k} + rank) as s, rank as b, null as v from lex_{tag} union all select query, doc, 1.0::double / ({CONFIG.rrf_k} + rank), null, rank from vec_{tag}) group by 1, 2),
top_{tag} as materialized (select query, doc, rrf_score, row_number() over (partition by query order by rrf_score desc, b nulls last, v nulls last, doc) as rank from both_{tag} qualify rank <= {CONFIG.size})""")
    parts.append(f"few as (select cv_id as query from cv_profiles where cv_id not in (select query from top_s group by 1 having count(*) >= {CONFIG.relax_below}))")
    parts.append("relaxed as (select *, false as is_relaxed from top_s where query not in (select query from few) union all select *, true from top_l where query in (select query from few))")
    return "with " + ",\n".join(parts)
_NUMBERED = "cvn as (select cv_id, row_number() over (order by cv_id) as no from cv_profiles), nv as (select count(*) as n from embeddings)"


def _vector_sql(name: str, k: int, where: str = "true") -> str:
    return f"""{name} as (
  select query, doc, row_number() over (partition by query order by score desc, doc) as rank from (
    select c.cv_id as query, j.job_id as doc, round((1 + list_cosine_similarity(qe.embedding::double[], je.embedding::double[])) / 2, 6) as score
    from cvn c cross join nv join embeddings qe on qe.vec_id = c.no % n cross join (select job_id, job_id as doc from jobs) j join embeddings je on je.vec_id = j.job_id % n where {where.replace('doc in', 'j.doc in')})
  qualify rank <= {k})"""


def _fused_sql(k: int) -> str:
    return f"""fused as (
  select query, doc, round(sum(s), 8) as rrf_score, max(bm25_rank) as bm25_rank, max(knn_rank) as knn_rank from (
    select query, doc, 1.0::double / ({CONFIG.rrf_k} + rank) as s, rank as bm25_rank, null as knn_rank from lex
    union all select query, doc, 1.0::double / ({CONFIG.rrf_k} + rank), null, rank from vecs) group by 1, 2),
placed as (select *, count(*) over (partition by query) as total, row_number() over (partition by query order by rrf_score desc, bm25_rank nulls last, knn_rank nulls last, doc) as rank from fused),
top as (select * from placed where rank <= {k})"""


def _pair_sql(hits: str) -> str:
    cv = ", ".join(f"{x} as {n}" for n, x in _cv_cols(CHECK).items())
    job = ", ".join(f"{x} as {n}" for n, x in _job_cols(CHECK).items())
    return f"""{_cities_sql('cvc', 'cv_profiles', 'cv_id', 'cv_location')},
{_cities_sql('jobc', 'jobs', 'job_id', 'job_location')},
cvs as (select cv_id as query, {cv} from cv_profiles), jbs as (select job_id as doc, {job} from jobs),
pairs as (select h.*, cvs.* exclude (query), jbs.* exclude (doc), cvc.cities as cv_cities, jobc.cities as job_cities
  from ({hits}) h join cvs using (query) join jbs using (doc) join cvc on cvc.cv_id = h.query join jobc on jobc.job_id = h.doc)"""


_LEX_HITS = f"select query, doc, rank from ({_topk(_boosted(LEXICAL, CONFIG.msm), CONFIG.size)})"
_RANKED = f"""select query, doc, place, match_score, row_number() over (partition by query order by match_score desc, place) as position from (
  select query, doc, place, case when place <= {CONFIG.scored} then total else {CONFIG.tail_score}::double end as match_score from """
_TOTAL = m.weighted(_scores(CHECK))
_RUBRIC = ", ".join(f"CAST({x} AS double) as {k}" for k, x in _scores(CHECK).items())

ORACLE: dict[str, str] = {
    "tokenize_stats": f"with {_index_sql(['title', 'technical_skills'])} select field, term, count(*) as df, sum(tf)::bigint as cf from idx group by 1, 2",
    "bm25_topk": f"with {_index_sql(['technical_skills'])}, {_terms_sql(_CV_TEXT)}, {_SCORE} {_topk('per_field', 10)}",
    "bm25_msm": f"with {_index_sql(['technical_skills', 'job_requirements'])}, {_terms_sql(_CV_TEXT)}, {_SCORE} select field, matched, count(*) as n_pairs, round(max(score), 6) as best from per_field where {_enough(CONFIG.msm)} group by 1, 2",
    "multi_match_best_fields": f"{_LEX} {_topk(_boosted(LEXICAL, CONFIG.msm), 10)}",
    "browse_search": f"with {_index_sql([f for f in BROWSE if f != 'category'])}, {_terms_sql(f'select 1 as query, {CHECK.lit(BROWSE_TEXT)} as txt')}, {_SCORE} {_topk(_boosted({f: b for f, b in BROWSE.items() if f != 'category'}, 0.0), 20, 'doc, score, rank')}",
    "browse_page": "select job_id, title from jobs order by try_strptime(crawled_date, '%Y-%m-%d %H:%M:%S') desc nulls last, job_id limit 20 offset 40",
    "filter_category": "select job_id, category from jobs where category in ('IT', 'Marketing')",
    "filter_gender": f"select c.gender, j.gender_requirement, j.n_jobs from (select gender_requirement, count(*) as n_jobs from jobs group by 1) j join (select distinct gender from cv_profiles) c on {_open_pairs(CHECK)}",
    "filter_not_expired": "select job_id from jobs where not coalesce(is_expired, false)",
    "knn_topk": "select query, doc, score, rank from (select q.vec_id as query, c.vec_id as doc, round((1 + list_cosine_similarity(q.embedding::double[], c.embedding::double[])) / 2, 6) as score, row_number() over (partition by q.vec_id order by round((1 + list_cosine_similarity(q.embedding::double[], c.embedding::double[])) / 2, 6) desc, c.vec_id) as rank from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0) where rank <= 10",
    "knn_prefiltered": "select query, doc, score, rank from (select q.vec_id as query, c.vec_id as doc, round((1 + list_cosine_similarity(q.embedding::double[], c.embedding::double[])) / 2, 6) as score, row_number() over (partition by q.vec_id order by round((1 + list_cosine_similarity(q.embedding::double[], c.embedding::double[])) / 2, 6) desc, c.vec_id) as rank from embeddings q join embeddings c on q.vec_id <> c.vec_id and q.label = c.label where q.vec_id % 100 = 0) where rank <= 10",
    "rrf_fusion": f"{_LEX}, lex as ({_topk(_boosted(LEXICAL, CONFIG.msm), 20)}), {_NUMBERED}, {_vector_sql('vecs', 20)}, {_fused_sql(20)} select query, doc, rrf_score, bm25_rank, knn_rank, rank from top",
    "hybrid_search": f"{_LEX}, lex as ({_topk(_boosted(LEXICAL, CONFIG.msm, _OPEN), CONFIG.size)}), {_NUMBERED}, {_vector_sql('vecs', CONFIG.size, _OPEN)}, {_fused_sql(CONFIG.size)} select query, doc, rrf_score, rank, total from top",
    "hybrid_relaxed": f"{_relaxed_sql()} select query, doc, rrf_score, rank, is_relaxed from relaxed",
    "gazetteer_match": f"with {_cities_sql('jobc', 'jobs', 'job_id', 'job_location')} select job_id, unnest(cities) as ref_id from jobc",
    "city_score": f"{_LEX}, {_pair_sql(_LEX_HITS)} select query, doc, {geo.city_score(CHECK, 'cv_cities', 'job_cities', CONFIG.same_city, CONFIG.other_city, CONFIG.unknown_city)} as score from pairs",
    "distance_score": f"with g as (select company_address, min(lat) as lat, min(lng) as lng from geocode_cache where lat is not null and lng is not null group by 1) select job_id, round({geo.distance_km('latitude', 'longitude', 'lat', 'lng')}, 3) as km, {geo.distance_score(geo.distance_km('latitude', 'longitude', 'lat', 'lng'), CONFIG.distance_km, CONFIG.location_floor)} as score from jobs join g using (company_address) where latitude is not null and longitude is not null",
    "same_city_partition": f"""{_LEX}, {_cities_sql('cvc', 'cv_profiles', 'cv_id', 'cv_location')}, {_cities_sql('jobc', 'jobs', 'job_id', 'job_location')},
hits as (select query, doc, rank, list_has_any(cvc.cities, jobc.cities) as same_city from ({_topk(_boosted(LEXICAL, CONFIG.msm), 20)}) h join cvc on cvc.cv_id = h.query join jobc on jobc.job_id = h.doc)
select query, doc, rank, same_city, row_number() over (partition by query order by same_city desc, rank) as place from hits""",
    "rubric_scores": f"{_LEX}, {_pair_sql(_LEX_HITS)} select query, doc, {_RUBRIC} from pairs",
    "wsm_total": f"{_LEX}, {_pair_sql(_LEX_HITS)}, sc as (select query, doc, {_RUBRIC} from pairs) select query, doc, {m.weighted({k: k for k in CONFIG.weights})} as total from sc",
    "fallback_score": f"{_LEX} select query, doc, {m.fallback('(rank - 1)')} as score from ({_LEX_HITS})",
    "head_tail_rank": f"{_LEX}, {_pair_sql(_LEX_HITS)} {_RANKED} (select query, doc, rank as place, {_TOTAL} as total from pairs))",
    "match_pipeline": f"""{_relaxed_sql()},
{_pair_sql('select query, doc, rank from relaxed')} {_RANKED} (select query, doc, row_number() over (partition by query order by list_has_any(cv_cities, job_cities) desc, rank) as place, {_TOTAL} as total from pairs))""",
}
