"""Record functions, expansion, ingestion and reports, with the SQL that checks them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import CONFIG
from ..functions import geo, salary
from ..functions import records as rec
from ..functions.columns import evaluated
from ..functions.dialect import CHECK, SPARK, Spark, column
from ..operators import diversity, expansion, ingest, reports
from ..operators import retrieval as r
from ..sources.tables import cut, table
from ..streaming.upsert import stream_upsert as run_stream

AS_OF = "2026-03-01"
CUTOFF = "2026-03-01 00:00:00"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _scalar(name: str, source: str, key: str, cols, first=None) -> None:
    """A query that is one projection: ``cols`` gives the columns' SQL for a dialect.

    What several columns need is in ``first``, which is evaluated once per row.
    """

    def run(s: SparkSession, d: str) -> DataFrame:
        df = table(s, d, source)
        if first is not None:
            df = evaluated(df, {n: column(x) for n, x in first(SPARK).items()})
        return df.select(*key.split(", "), *[column(x).alias(n) for n, x in cols(SPARK).items()])

    run.__name__ = name
    QUERIES[name] = run
    of = source if first is None else f"(select *, {', '.join(f'{x} as {n}' for n, x in first(CHECK).items())} from {source})"
    ORACLE[name] = f"select {key}, " + ", ".join(f"{x} as {n}" for n, x in cols(CHECK).items()) + f" from {of}"


def _pay(q: Spark, k: str | None = None) -> dict[str, str]:
    k = k or salary.kind(q, "job_salary")
    return {"kind": k, "pay_min": salary.bound(q, "job_salary", k, False), "pay_max": salary.bound(q, "job_salary", k, True)}


def _stated(q: Spark) -> dict[str, str]:
    return {"_in_pay": salary.stated_millions(q, "job_salary"), "_in_title": salary.stated_millions(q, "title")}


def _repair(q: Spark) -> dict[str, str]:
    stated = f"(CASE WHEN {q.size('_in_pay')} > 0 THEN _in_pay ELSE _in_title END)"
    return {"pay_min": salary.repaired(q, stated, "salary_min", "salary_max", False), "pay_max": salary.repaired(q, stated, "salary_min", "salary_max", True)}


def rec_day(q: Spark) -> str:
    return f"nullif({q.ext('coalesce(deadline, ' + q.lit('') + ')', '([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})')}, '')"


_scalar("salary_normalize", "jobs", "job_id", lambda q: _pay(q, "_kind"), lambda q: {"_kind": salary.kind(q, "job_salary")})
_scalar("salary_repair", "jobs", "job_id", _repair, _stated)
_scalar("simplify_address", "geocode_cache", "address_id", lambda q: {"short": geo.simplified(q, "company_address"), "branch": geo.first_branch(q, "company_address")})
_scalar("extract_city", "jobs", "job_id", lambda q: {"city": geo.city(q, "company_address", "job_location")})
_scalar("gender_repair", "jobs", "job_id", lambda q: {"gender": rec.gender(q, "title", "gender_requirement", "job_requirements")})
_scalar("education_normalize", "jobs", "job_id", lambda q: {"level": rec.education(q, "education_level")})
_scalar("commission_flag", "jobs", "job_id", lambda q: {"flag": rec.commission(q, "has_commission", "job_benefits", "salary_note", "job_description")})
_scalar("classify_tier", "jobs", "job_id", lambda q: {"tier": rec.tier(q, "experience"), "tier_report": rec.tier(q, "experience", "junior")})
_scalar("deadline_expiry", "jobs", "job_id", lambda q: {"day": rec_day(q), "expired": rec.expired(q, rec_day(q), AS_OF)})
_scalar("canonical_url", "jobs", "job_id", lambda q: {"canonical": rec.canonical_url(q, "url")})
_scalar("valid_url", "jobs", "job_id", lambda q: {"valid": rec.valid_url(q, "url"), "title_ok": rec.valid_title(q, "title")})
_scalar("content_hash", "raw_jobs", "url, loaded_at", lambda q: {"digest": rec.content_key(q, "title", "job_details", "overview"), "doc_key": rec.content_key(q, "url")})
_scalar("clean_text", "jobs", "job_id", lambda q: {"title_text": rec.clean_text(q, "title"), "location_text": rec.clean_text(q, "job_location")})
_scalar("sections_extract", "raw_jobs", "url, loaded_at", lambda q: {n: rec.section(q, "job_details", h) for n, h in rec.SECTIONS.items()})
_scalar("overview_extract", "raw_jobs", "url, loaded_at", lambda q: {"tags": rec.requirement_tags(q, "overview"), "specialisations": rec.specialisations(q, "overview"), "experience": rec.overview_experience(q, "overview"), "deadline_text": rec.deadline_in(q, "'Hạn nộp hồ sơ: ' || deadline")})
_scalar("code_labels", "cv_profiles", "cv_id", lambda q: {"education_label": rec.codes(q, "education", rec.EDUCATION_CODES), "experience_label": rec.codes(q, "experience", rec.EXPERIENCE_CODES)})
_scalar("unit_coerce", "jobs", "job_id", lambda q: {"min_million": rec.millions(q, "salary_min"), "max_million": rec.millions(q, "salary_max")})
_BOOL = "CASE job_id % 6 WHEN 0 THEN 'True' WHEN 1 THEN '1' WHEN 2 THEN ' yes ' WHEN 3 THEN 'no' WHEN 4 THEN '' END"
_scalar("bool_coerce", "jobs", "job_id", lambda q: {"expired": rec.boolean(q, "is_expired"), "worded": rec.boolean(q, f"({_BOOL})")})
_scalar("score_clamp", "annotations", "cv_id, job_id, annotator, annotated_at, loaded_at", lambda q: {"skills": rec.score(q, "skills_match"), "education": rec.score(q, "education_match")})
_scalar("score_band", "annotations", "cv_id, job_id, annotator, annotated_at, loaded_at", lambda q: {"band": "CASE WHEN relevance_score >= 7 THEN 'high' WHEN relevance_score >= 4 THEN 'mid' ELSE 'low' END"})
_scalar("sanitize_document", "jobs", "job_id", lambda q: {f"{c}_text": rec.text(q, c) for c in ("title", "company", "company_address", "category", "technical_skills", "soft_skills", "languages", "certificates", "job_location", "experience", "education_level", "salary_note")})
# the overviews of the test table have 39 letters at most, so the gate's usual bound lets nothing pass; a lower one is shown beside it
_scalar("quality_gate", "raw_jobs", "url, loaded_at", lambda q: {"passes": rec.quality_gate(q, CONFIG.overview_least), "passes_short": rec.quality_gate(q, 15)})
_scalar("blocked_page", "documents", "doc_id", lambda q: {"blocked": rec.blocked_page(q, "text", CONFIG.page_least), "blocked_short": rec.blocked_page(q, "text", 100)})
_scalar("company_city", "jobs", "job_id", lambda q: {"city": geo.company_city(q, "company_address", "job_location")})


def _register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


WISHES = ["15 triệu", "Từ 15 triệu", "Thỏa thuận"]


def _compare_sql(q: Spark) -> str:
    return f"round({salary.compare(q, 'wk', 'wlo', 'whi', 'kind', 'pay_min', 'pay_max')}, 6)"


def _wish_cols(q: Spark, k: str | None = None) -> dict[str, str]:
    k = k or salary.kind(q, "wish")
    return {"wk": k, "wlo": salary.bound(q, "wish", k, False), "whi": salary.bound(q, "wish", k, True)}


@_register(
    f"with w as (select wish, {', '.join(f'{x} as {n}' for n, x in _wish_cols(CHECK).items())} from (select unnest([{', '.join(map(CHECK.lit, WISHES))}]) as wish)), "
    f"o as (select job_id, {', '.join(f'{x} as {n}' for n, x in _pay(CHECK).items())} from jobs) select job_id, wish, {_compare_sql(CHECK)} as score from o cross join w"
)
def salary_compare(s: SparkSession, d: str) -> DataFrame:
    wishes = evaluated(s.createDataFrame([(w,) for w in WISHES], "wish string"), {"_kind": column(salary.kind(SPARK, "wish"))})
    wishes = wishes.select("wish", *[column(x).alias(n) for n, x in _wish_cols(SPARK, "_kind").items()])
    offers = QUERIES["salary_normalize"](s, d)
    return offers.crossJoin(F.broadcast(wishes)).select("job_id", "wish", column(_compare_sql(SPARK)).alias("score"))  # three wishes


@_register(
    "select job_id, pos::int as pos, trim(p) as value from (select job_id, generate_subscripts(l, 1) - 1 as pos, unnest(l) as p from (select job_id, "
    + rec.listed(CHECK, "soft_skills")
    + " as l from jobs))"
)
def list_split(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "jobs").select("job_id", F.posexplode(column(rec.listed(SPARK, "soft_skills"))).alias("pos", "value"))


@_register(
    f"with k as (select job_id, url, {rec.keywords(CHECK, 'title', 'technical_skills', 'category')} as w from jobs where url is not null) "
    f"select a.job_id as job_id_a, b.job_id as job_id_b, round({rec.jaccard_distance(CHECK, 'a.w', 'b.w')}, 6) as distance from k a join k b on a.url = b.url and a.job_id < b.job_id"
)
def jaccard_pairs(s: SparkSession, d: str) -> DataFrame:
    """Between the crawls of one address."""
    k = table(s, d, "jobs").where("url is not null").select("job_id", "url", column(rec.keywords(SPARK, "title", "technical_skills", "category")).alias("w"))
    a, b = k.select("url", F.col("job_id").alias("job_id_a"), F.col("w").alias("wa")), k.select("url", F.col("job_id").alias("job_id_b"), F.col("w").alias("wb"))
    return a.join(b, "url").where("job_id_a < job_id_b").select("job_id_a", "job_id_b", column(f"round({rec.jaccard_distance(SPARK, 'wa', 'wb')}, 6)").alias("distance"))


_REPLY = "concat('Kết quả: ```json [{\"job\": 1, \"relevance\": ', coalesce(CAST(relevance_score AS {t}), 'null'), ', \"skills\": ', coalesce(CAST(skills_match AS {t}), 'null'), '}, {\"job\": 2}] ``` hết')"
_ANN = "cv_id, job_id, annotator, annotated_at, loaded_at"


@_register(
    f"""with t as (select {_ANN}, regexp_extract({_REPLY.replace('{t}', 'varchar')}, '(?s)\\[.*\\]', 0)::json as j from annotations),
u as (select {_ANN}, unnest(from_json(j, '[{{"job":"INTEGER","relevance":"VARCHAR","skills":"VARCHAR"}}]')) as x from t)
select {_ANN}, x.job as job_no, {rec.score(CHECK, 'x.relevance')} as relevance, {rec.score(CHECK, 'x.skills')} as skills from u"""
)
def llm_json_array(s: SparkSession, d: str) -> DataFrame:
    """Scores read from a model's reply with text around the list; what is missing is 5."""
    t = table(s, d, "annotations").select(*_ANN.split(", "), column(_REPLY.replace("{t}", "string")).alias("reply"))
    body = column(SPARK.ext("reply", r"(?s)\[.*\]", 0))
    u = t.select(*_ANN.split(", "), F.inline(F.from_json(body, "array<struct<job:int,relevance:string,skills:string>>")))
    return u.select(*_ANN.split(", "), F.col("job").alias("job_no"), column(rec.score(SPARK, "relevance")).alias("relevance"), column(rec.score(SPARK, "skills")).alias("skills"))


_OBJECT = "concat('Đây: {{\"salary\": {{\"text\": \"', coalesce(regexp_replace(job_salary, '[^0-9a-zA-Z ]', ''{g}), ''), '\", \"min\": ', coalesce(CAST(CAST(floor(salary_min) AS bigint) AS {t}), 'null'), ',}}, \"skills\": [\"Word\", \"SQL\",], // ghi chú', chr(10), ' \"location\": {{\"city\": \"Huế\"}}}} xong')"


def _lenient(q: Spark) -> str:
    x = q.ext(_OBJECT.format(t="string" if type(q) is Spark else "varchar", g="" if type(q) is Spark else ", 'g'"), r"(?s)\{.*\}", 0)
    return q.repl(q.repl(q.repl(x, r",\s*\}", "}"), r",\s*\]", "]"), r"//[^\n]*\n", "\n")


@_register(
    f"with t as (select job_id, ({_lenient(CHECK)})::json as j from jobs) select job_id, j->'salary'->>'text' as pay_text, CAST(j->'salary'->>'min' AS double) as pay_min, j->'location'->>'city' as city, "
    "array_to_string(from_json(j->'skills', '[\"VARCHAR\"]'), ', ') as skills from t"
)
def llm_json_object(s: SparkSession, d: str) -> DataFrame:
    """A reply with a comment and trailing commas, flattened."""
    kind = "struct<salary:struct<text:string,min:double>,location:struct<city:string>,skills:array<string>>"
    t = table(s, d, "jobs").select("job_id", F.from_json(column(_lenient(SPARK)), kind).alias("j"))
    return t.select("job_id", F.col("j.salary.text").alias("pay_text"), F.col("j.salary.min").alias("pay_min"), F.col("j.location.city").alias("city"), F.array_join("j.skills", ", ").alias("skills"))


_SIMPLE = geo.simplified(CHECK, "company_address")


@_register(
    f"""with g as (select company_address as k, min(lat) as lat, min(lng) as lng from geocode_cache where lat is not null group by 1),
s as (select {_SIMPLE} as k, min(lat) as lat from geocode_cache where lat is not null group by 1),
c as (select {geo.city(CHECK, 'company_address', 'NULL')} as k, min(lat) as lat from geocode_cache where lat is not null group by 1)
select address_id, coalesce(g.lat, s.lat, c.lat) as lat, case when g.lat is not null then 'full' when s.lat is not null then 'simplified' when c.lat is not null then 'city' else 'failed' end as method
from geocode_cache a left join g on g.k = a.company_address left join s on s.k = {geo.simplified(CHECK, 'a.company_address')} and s.k <> '' left join c on c.k = {geo.city(CHECK, 'a.company_address', 'NULL')} and c.k <> ''"""
)
def geocode_chain(s: SparkSession, d: str) -> DataFrame:
    """A point for each address: of the address itself, of its simplified form, of its city."""
    g = table(s, d, "geocode_cache")
    forms = {"full": "company_address", "simplified": geo.simplified(SPARK, "company_address"), "city": geo.city(SPARK, "company_address", "CAST(NULL AS string)")}
    out = g.select("address_id", *[column(x).alias(f"k_{n}") for n, x in forms.items()])
    for n, x in forms.items():
        known = g.where("lat is not null").groupBy(column(x).alias(f"k_{n}")).agg(F.min("lat").alias(f"lat_{n}"))
        out = out.join(known.where(F.col(f"k_{n}") != "") if n != "full" else known, f"k_{n}", "left")
    method = F.coalesce(*[F.when(F.col(f"lat_{n}").isNotNull(), F.lit(n)) for n in forms], F.lit("failed"))
    return out.select("address_id", F.coalesce(*[F.col(f"lat_{n}") for n in forms]).alias("lat"), method.alias("method"))


@_register(f"select method, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 2) as percent from ({ORACLE['geocode_chain']}) group by 1")
def geocode_stats(s: SparkSession, d: str) -> DataFrame:
    return reports.distribution(geocode_chain(s, d), F.col("method"), "method")


# ------------------------------------------------------------------ expansion
_SKILLS = rec.listed(CHECK, "technical_skills")
_LABELS = f"""js as (select distinct job_id, p as skill from (select job_id, unnest({_SKILLS}) as p from jobs)),
co as (select a.skill as label, b.skill as alt, count(*) as n from js a join js b on a.job_id = b.job_id and lower(a.skill) <> lower(b.skill) group by 1, 2),
labels as (select label, alt, row_number() over (partition by label order by n desc, alt) as alt_no from co qualify alt_no <= 3)"""


def _labels(s: SparkSession, d: str) -> DataFrame:
    """Each skill's three most frequent companions in adverts, as its other labels."""
    js = table(s, d, "jobs").select("job_id", F.explode(column(rec.listed(SPARK, "technical_skills"))).alias("skill")).distinct()
    both = js.select("job_id", F.col("skill").alias("label")).join(js.select("job_id", F.col("skill").alias("alt")), "job_id").where("lower(label) <> lower(alt)")  # the skills of one advert
    w = W.partitionBy("label").orderBy(F.desc("n"), "alt")
    return both.groupBy("label", "alt").agg(F.count("*").alias("n")).withColumn("alt_no", F.row_number().over(w)).where("alt_no <= 3").select("label", "alt_no", "alt")


_PLACED = "select {k}, row_number() over (partition by {k} order by part, a, b, term) as place, term from (select {k}, part, a, b, term, row_number() over (partition by {k}, lower(term) order by part, a, b, term) as n from parts) where n = 1"


@_register(
    f"""with {_LABELS},
t0 as (select cv_id, generate_subscripts(l, 1) as pos, unnest(l) as term from (select cv_id, {rec.listed(CHECK, 'skills')} as l from cv_profiles)),
t as (select cv_id, pos - 1 as pos, trim(term) as term from t0 qualify row_number() over (partition by cv_id, lower(trim(term)) order by pos) = 1),
parts as (select cv_id, 0 as part, pos as a, 0 as b, term from t union all select cv_id, 1, pos, alt_no, alt from t join labels on lower(term) = lower(label))
{_PLACED.format(k='cv_id')}"""
)
def expand_exact(s: SparkSession, d: str) -> DataFrame:
    rows = expansion.term_rows(table(s, d, "cv_profiles"), "cv_id", column(rec.listed(SPARK, "skills")))
    return expansion.expand_exact(rows, "cv_id", _labels(s, d))


@_register(
    f"select query, doc, score, score >= {CONFIG.min_similarity}::double as is_near from (select q.vec_id as query, c.vec_id as doc, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) as score, row_number() over (partition by q.vec_id order by round((1 + list_cosine_similarity(q.embedding::double[], c.embedding::double[])) / 2, 8) desc, c.vec_id) as n from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0) where n = 1"
)
def expand_vector(s: SparkSession, d: str) -> DataFrame:
    """The label nearest to each queried vector, and whether it is near enough to be taken."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit(0).alias("tag"))
    near = r.nearest(v.where("id % 100 = 0"), v, 8)
    exact = near.join(v.select(F.col("id").alias("query"), F.col("vec").alias("a")), "query").join(v.select(F.col("id").alias("doc"), F.col("vec").alias("b")), "doc")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, z: t + z)
    cos = dot(F.col("a"), F.col("b")) / F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))
    w = W.partitionBy("query").orderBy(F.desc(F.round((1 + cos) / 2, 8)), "doc")
    return exact.withColumns({"n": F.row_number().over(w), "score": F.round(cos, 6)}).where("n = 1").select("query", "doc", "score", (F.col("score") >= CONFIG.min_similarity).alias("is_near"))


def _edges(s: SparkSession, d: str) -> DataFrame:
    """A skill graph over the parts: brand as broader skill, supplier as occupation, nation as tool."""
    part, line, supp, nation = (table(s, d, t) for t in ("part", "lineitem", "supplier", "nation"))
    skill = F.concat(F.lit("s"), "p_partkey")
    broader = part.select(skill.alias("src"), F.col("p_brand").alias("dst"), F.lit("broader").alias("kind"), F.col("p_brand").alias("title"))
    narrower = part.select(F.col("p_brand").alias("src"), skill.alias("dst"), F.lit("narrower").alias("kind"), F.col("p_name").alias("title"))
    uses = line.select("l_partkey", "l_suppkey").distinct()
    occ = F.concat(F.lit("o"), "l_suppkey")
    needed = uses.select(F.concat(F.lit("s"), "l_partkey").alias("src"), occ.alias("dst"), F.lit("needed").alias("kind"), occ.alias("title"))
    needs = uses.join(part, F.col("l_partkey") == F.col("p_partkey")).select(occ.alias("src"), skill.alias("dst"), F.lit("needs").alias("kind"), F.col("p_name").alias("title"))
    tools = supp.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("o"), "s_suppkey").alias("src"), F.concat(F.lit("t"), "n_nationkey").alias("dst"), F.lit("tool").alias("kind"), F.col("n_name").alias("title"))
    return broader.unionByName(narrower).unionByName(needed).unionByName(needs).unionByName(tools)


_EDGES = """edges as (
  select 's' || p_partkey as src, p_brand as dst, 'broader' as kind, p_brand as title from part
  union all select p_brand, 's' || p_partkey, 'narrower', p_name from part
  union all select distinct 's' || l_partkey, 'o' || l_suppkey, 'needed', 'o' || l_suppkey from lineitem
  union all select distinct 'o' || l_suppkey, 's' || l_partkey, 'needs', p_name from lineitem join part on l_partkey = p_partkey
  union all select 'o' || s_suppkey, 't' || n_nationkey, 'tool', n_name from supplier join nation on s_nationkey = n_nationkey),
start as (select 's' || p_partkey as src from part where p_partkey % 100 = 0)"""


def _near_sql(up: str, down: str, cap: int) -> str:
    return f"""(select src, title, place from (select src, title, row_number() over (partition by src order by title, other) as place from (
  select distinct a.src, b.dst as other, b.title from edges a join start using (src) join edges b on b.src = a.dst and b.kind = '{down}' where a.kind = '{up}' and a.src <> b.dst)) where place <= {cap})"""


def _start(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").where("p_partkey % 100 = 0").select(F.concat(F.lit("s"), "p_partkey").alias("src"))


@_register(f"with {_EDGES} select * from {_near_sql('broader', 'narrower', CONFIG.sibling_cap)}")
def graph_siblings(s: SparkSession, d: str) -> DataFrame:
    return expansion.neighbours(_edges(s, d), _start(s, d), ("broader", "narrower"), CONFIG.sibling_cap)


@_register(f"with {_EDGES} select * from {_near_sql('needed', 'needs', CONFIG.sibling_cap)}")
def graph_cooccurring(s: SparkSession, d: str) -> DataFrame:
    return expansion.neighbours(_edges(s, d), _start(s, d), ("needed", "needs"), CONFIG.sibling_cap)


@_register(f"with {_EDGES} select * from {_near_sql('needed', 'tool', CONFIG.sibling_cap)}")
def graph_tools(s: SparkSession, d: str) -> DataFrame:
    return expansion.neighbours(_edges(s, d), _start(s, d), ("needed", "tool"), CONFIG.sibling_cap)


@_register(
    f"""with recursive {_EDGES}, up(src, node, depth) as (
  select src, src, 0 from start union select u.src, e.dst, u.depth + 1 from up u join edges e on e.src = u.node and e.kind in ('broader', 'needed', 'tool') where u.depth < 2)
select src, node, min(depth) as depth from up where depth > 0 group by 1, 2"""
)
def graph_broader(s: SparkSession, d: str) -> DataFrame:
    """Everything above a skill within two steps, at its least depth; nodes seen before aren't followed again."""
    edges = _edges(s, d).where("kind in ('broader', 'needed', 'tool')").select(F.col("src").alias("node"), "dst")
    seen = _start(s, d).select("src", F.col("src").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for depth in (1, 2):
        step = front.join(edges, "node").select("src", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("src", "node"), ["src", "node"], "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


@_register(
    f"""with {_EDGES}, parts as (
  select e.src, 0 as part, 0 as a, 0 as b, e.title as term from edges e join start using (src) where e.kind = 'broader'
  union all select src, 1, place, 0, title from {_near_sql('broader', 'narrower', 5)}
  union all select src, 2, place, 0, title from {_near_sql('needed', 'needs', 5)}
  union all select src, 3, place, 0, title from {_near_sql('needed', 'tool', 5)})
select * from ({_PLACED.format(k='src')}) where place <= 15"""
)
def graph_expand(s: SparkSession, d: str) -> DataFrame:
    """Broader skills, then siblings, companions and tools, five of each at most, fifteen terms in all."""
    edges, start = _edges(s, d), _start(s, d)
    one = edges.where("kind = 'broader'").join(start, "src", "left_semi").select("src", F.lit(0).alias("part"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("title").alias("term"))
    for part, kinds in enumerate((("broader", "narrower"), ("needed", "needs"), ("needed", "tool")), 1):
        near = expansion.neighbours(edges, start, kinds, 5)
        one = one.unionByName(near.select("src", F.lit(part).alias("part"), F.col("place").alias("a"), F.lit(0).alias("b"), F.col("title").alias("term")))
    return expansion.placed(one, "src", 15)


# ------------------------------------------------------------------ ingestion
_CANON = rec.canonical_url(CHECK, "url")


@_register(f"select job_id, canonical from (select job_id, {_CANON} as canonical, row_number() over (partition by {_CANON} order by crawled_date nulls first, job_id) as n from jobs where url is not null) where n = 1")
def dedup_first_seen(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "jobs").where("url is not null").select("job_id", "crawled_date", column(rec.canonical_url(SPARK, "url")).alias("canonical"))
    return ingest.first_seen(j, ["canonical"], [F.asc_nulls_first("crawled_date"), "job_id"]).select("job_id", "canonical")


_LAST = "select url, content_hash, loaded_at from (select *, row_number() over (partition by url order by loaded_at desc nulls last, content_hash desc nulls last) as n from raw_jobs where url is not null and trim(url) <> '') where n = 1"


@_register(_LAST)
def dedup_last_wins(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "raw_jobs").where("url is not null and trim(url) <> ''").select("url", "content_hash", "loaded_at")
    return ingest.last_wins(raw, ["url"], ["loaded_at", "content_hash"])


_OLD = f"select url, content_hash, seen from (select url, content_hash, crawled_date as seen, row_number() over (partition by url order by crawled_date desc nulls last, job_id desc) as n from jobs where url is not null and crawled_date < '{CUTOFF}') where n = 1"


def _old(s: SparkSession, d: str) -> DataFrame:
    """What the table held at the cutoff: the last crawl of each address."""
    j = table(s, d, "jobs").where(F.col("url").isNotNull() & (F.col("crawled_date") < CUTOFF)).select("url", "content_hash", F.col("crawled_date").alias("seen"), "job_id")
    return ingest.last_wins(j, ["url"], ["seen", "job_id"]).select("url", "content_hash", "seen")


_ACTIONS = f"select url, case when n.url is null then 'keep' when o.url is null then 'insert' when o.content_hash is not distinct from n.content_hash then 'touch' else 'update' end as action, coalesce(n.content_hash, o.content_hash) as content_hash from ({_OLD}) o full join ({_LAST}) n using (url)"


@_register(_ACTIONS)
def upsert_actions(s: SparkSession, d: str) -> DataFrame:
    return ingest.upsert_actions(_old(s, d), dedup_last_wins(s, d), "url", "content_hash")


@_register(f"select action, count(*) as n from ({_ACTIONS}) group by 1")
def upsert_counts(s: SparkSession, d: str) -> DataFrame:
    return upsert_actions(s, d).groupBy("action").agg(F.count("*").alias("n"))


@_register(f"select url, case when n.url is not null and o.content_hash is distinct from n.content_hash then n.content_hash else coalesce(o.content_hash, n.content_hash) end as content_hash, case when n.url is not null then '{AS_OF}' else o.seen end as seen from ({_OLD}) o full join ({_LAST}) n using (url)")
def upsert_merge(s: SparkSession, d: str) -> DataFrame:
    return ingest.merged(_old(s, d), dedup_last_wins(s, d).select("url", "content_hash"), "url", "content_hash", "seen", F.lit(AS_OF))


@_register(
    f"""with u as (select distinct url from raw_jobs where url is not null and trim(url) <> ''), k as (select url, max(try_strptime(crawled_date, '%Y-%m-%d %H:%M:%S')) as seen_at from jobs where url is not null and crawled_date < '{CUTOFF}' group by 1)
select u.url, case when k.url is null then 'new' when seen_at is null or date_diff('day', seen_at::date, DATE '{AS_OF}') >= {CONFIG.recrawl_days} then 'recrawl' else 'skip' end as status from u left join k on u.url = k.url"""
)
def precheck_urls(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "jobs").where(F.col("url").isNotNull() & (F.col("crawled_date") < CUTOFF))
    known = j.select("url", F.try_to_timestamp(F.col("crawled_date"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("seen_at"))
    return ingest.precheck(table(s, d, "raw_jobs"), known, F.lit(AS_OF).cast("date"), CONFIG.recrawl_days)


@_register(f"select job_id, is_expired, (coalesce(is_expired, false) or {rec.expired(CHECK, rec_day(CHECK), AS_OF)}) as now_expired from jobs")
def mark_expired(s: SparkSession, d: str) -> DataFrame:
    now = F.coalesce("is_expired", F.lit(False)) | column(rec.expired(SPARK, rec_day(SPARK), AS_OF))
    return table(s, d, "jobs").select("job_id", "is_expired", now.alias("now_expired"))


@_register(f"select distinct url, content_hash from raw_jobs where url is not null and (content_hash is null or content_hash not in (select content_hash from jobs where content_hash is not null and crawled_date < '{CUTOFF}')) and url not in (select url from jobs where url is not null and crawled_date < '{CUTOFF}')")
def anti_dedup(s: SparkSession, d: str) -> DataFrame:
    """Raw records known by neither key; two anti joins instead of an OR."""
    old = table(s, d, "jobs").where(F.col("crawled_date") < CUTOFF)
    raw = table(s, d, "raw_jobs").where("url is not null").select("url", "content_hash").distinct()
    return raw.join(old.select("content_hash").where("content_hash is not null"), "content_hash", "left_anti").join(old.select("url").where("url is not null"), "url", "left_anti").select("url", "content_hash")


_QUOTA = 30


@_register(
    f"""with t as (select job_id, coalesce(category, 'none') as category, {rec.tier(CHECK, 'experience')} as tier, crawled_date from jobs),
have as (select category, tier, count(*) as have from t where crawled_date < '2026-01-20' group by 1, 2),
cand as (select *, row_number() over (partition by category, tier order by crawled_date, job_id) as place from t where crawled_date >= '2026-01-20')
select job_id, category, tier, place from cand left join have using (category, tier) where place <= {_QUOTA} - coalesce(have, 0)"""
)
def quota_fill(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "jobs").select("job_id", F.coalesce("category", F.lit("none")).alias("category"), column(rec.tier(SPARK, "experience")).alias("tier"), "crawled_date")
    old, new = t.where("crawled_date < '2026-01-20'"), t.where("crawled_date >= '2026-01-20'")
    return ingest.quota_fill(new, old, ["category", "tier"], ["crawled_date", "job_id"], _QUOTA).select("job_id", "category", "tier", "place")


@_register(
    f"""with t as (select coalesce(category, 'none') as category, {rec.tier(CHECK, 'experience')} as tier, url, row_number() over (partition by coalesce(category, 'none'), {rec.tier(CHECK, 'experience')} order by crawled_date nulls first, job_id) as p from jobs where url is not null),
f as (select category, url, min((p, tier)) as o from t group by 1, 2) select category, url, row_number() over (partition by category order by o, url) as place from f"""
)
def interleave(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "jobs").where("url is not null").select(F.coalesce("category", F.lit("none")).alias("category"), column(rec.tier(SPARK, "experience")).alias("tier"), "url", "crawled_date", "job_id")
    return ingest.interleaved(t, "category", "tier", ["crawled_date", "job_id"], "url")


@_register("select url, 'both' as side from (select url from jobs where url is not null intersect select url from raw_jobs) union all select url, 'jobs' from (select url from jobs where url is not null except select url from raw_jobs where url is not null) union all select url, 'raw' from (select url from raw_jobs where url is not null except select url from jobs where url is not null)")
def url_union_diff(s: SparkSession, d: str) -> DataFrame:
    a, b = (table(s, d, t).select("url").where("url is not null") for t in ("jobs", "raw_jobs"))
    side = lambda df, n: df.withColumn("side", F.lit(n))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "jobs")).unionByName(side(b.subtract(a), "raw"))


@_register(r"""select doc_id, link, count(*) as n from (select doc_id, regexp_replace('https://van-ban.example' || unnest(regexp_extract_all(text, 'href="([^"]+)"', 1)), '\?.*$', '') as link from documents where text is not null) group by 1, 2""")
def page_links(s: SparkSession, d: str) -> DataFrame:
    links = table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit('href="([^"]+)"'), F.lit(1))).alias("l"))
    return links.groupBy("doc_id", F.regexp_replace(F.concat(F.lit("https://van-ban.example"), "l"), r"\?.*$", "").alias("link")).agg(F.count("*").alias("n"))


@_register("select job_id, ntile(16) over (order by job_id) as chunk from jobs where job_id is not null")
def even_chunks(s: SparkSession, d: str) -> DataFrame:
    """Contiguous chunks whose sizes differ by one at most, by a distributed count instead of one window over all rows."""
    j = table(s, d, "jobs").where("job_id is not null").select("job_id").repartitionByRange("job_id").sortWithinPartitions("job_id")
    part = j.withColumn("p", F.spark_partition_id())
    part = cut(part)
    counts = part.groupBy("p").agg(F.count("*").alias("c"))  # a row a partition
    offs = counts.select("p", (F.sum("c").over(W.orderBy("p")) - F.col("c")).alias("off"), F.sum("c").over(W.partitionBy(F.lit(0))).alias("total"))
    at = part.withColumn("i", F.row_number().over(W.partitionBy("p").orderBy("job_id"))).join(F.broadcast(offs), "p")
    i, q, rem = F.col("off") + F.col("i") - 1, F.floor(F.col("total") / 16), F.col("total") % 16
    return at.select("job_id", F.when(i < rem * (q + 1), F.floor(i / (q + 1)) + 1).otherwise(rem + F.floor((i - rem * (q + 1)) / F.greatest(q, F.lit(1))) + 1).cast("bigint").alias("chunk"))


@_register("select job_id, job_id % 4 as worker from jobs")
def round_robin(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "jobs").select("job_id", F.pmod("job_id", F.lit(4)).alias("worker"))


# ------------------------------------------------------------------ reports
@_register(f"select coalesce(salary_type, 'none') as kind, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 2) as percent from jobs group by 1")
def salary_type_distribution(s: SparkSession, d: str) -> DataFrame:
    return reports.distribution(table(s, d, "jobs"), F.coalesce("salary_type", F.lit("none")), "kind")


@_register(f"with t as (select coalesce(category, 'none') as category, {rec.tier(CHECK, 'experience')} as tier from jobs) select coalesce(category, 'total') as category, coalesce(tier, 'total') as tier, count(*) as n from t group by cube (category, tier)")
def category_tier_cube(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "jobs").select("category", column(rec.tier(SPARK, "experience")).alias("tier"))
    return reports.cube_counts(t, ["category", "tier"])


@_register("select coalesce(category, 'none') as category, count(*) as n, count(distinct url) as urls, count(distinct content_hash) as hashes, count(distinct company) as companies from jobs group by 1")
def distinct_report(s: SparkSession, d: str) -> DataFrame:
    g = table(s, d, "jobs").groupBy(F.coalesce("category", F.lit("none")).alias("category"))
    return g.agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"), F.count_distinct("content_hash").alias("hashes"), F.count_distinct("company").alias("companies"))


@_register("with h as (select distinct content_hash from jobs where content_hash is not null) select count(*) as n_rows, count(h.content_hash) as n_hit, count(distinct job_id) as n_jobs, count(distinct h.content_hash) as n_jobs_hit from annotations a left join h on h.content_hash = a.job_id")
def overlap_report(s: SparkSession, d: str) -> DataFrame:
    h = table(s, d, "jobs").select("content_hash").where("content_hash is not null").distinct()
    a = table(s, d, "annotations").select("job_id").groupBy("job_id").agg(F.count("*").alias("n"))  # a hot advert is one row before the join
    j = a.join(h, F.col("job_id") == F.col("content_hash"), "left")
    hit = F.col("content_hash").isNotNull()
    return j.agg(F.sum("n").alias("n_rows"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_hit"), F.count("job_id").alias("n_jobs"), F.count("content_hash").alias("n_jobs_hit"))


DIMS = ["relevance_score", "skills_match", "experience_match", "education_match"]


@_register(
    "with l as (" + " union all ".join(f"select cv_id, job_id, '{x}' as dimension, {x} as score from annotations where {x} between 0 and 10" for x in DIMS) + f"), s as (select cv_id, job_id, dimension, max(score) - min(score) as spread from l group by 1, 2, 3) select dimension, count(*) as n_items from s where spread > {CONFIG.disagreement} group by 1"
)
def annotator_disagreement(s: SparkSession, d: str) -> DataFrame:
    return reports.disagreement(table(s, d, "annotations"), ["cv_id", "job_id"], DIMS, CONFIG.disagreement)


# ------------------------------------------------------------------ without SQL
@_register()
def diverse_select(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "jobs").select("category", "job_id", column(rec.keywords(SPARK, "title", "technical_skills")).alias("words"))
    return diversity.diverse(j, "category", "job_id", "words", 20)


@_register(_LAST.replace("select url, content_hash, loaded_at", "select url, content_hash").replace(" and trim(url) <> ''", ""))
def stream_upsert(s: SparkSession, d: str) -> DataFrame:
    """The records of a crawl as a stream of files.  With several files a later one wins, whatever ``loaded_at`` says."""
    schema = table(s, d, "raw_jobs").schema
    source = f"{d}/raw_jobs.parquet"
    if os.path.isfile(source):  # a stream reads folders; one file is taken through a pattern
        source = f"{d}/raw_jobs.p[a]rquet"
    return run_stream(s, source, schema, "url", "content_hash", ["loaded_at"]).select("url", "content_hash")


@_register()
def knn_lsh(s: SparkSession, d: str) -> DataFrame:
    """The approximate way: vectors of length 1 meet only within buckets of random projections, then their distance is exact."""
    v = table(s, d, "embeddings")
    return r.nearest_by_hash(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", 10)
