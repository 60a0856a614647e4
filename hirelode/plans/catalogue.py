"""Sources, taxonomy, texts for models, scoring and paging as queries, each with SQL written by hand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import api
from ..config import CONFIG
from ..functions import geo, records
from ..functions.dialect import SPARK, column
from ..operators import encoding, expansion, matching, reports, scoring, taxonomy
from ..operators import retrieval as r
from ..sources import files
from ..sources.tables import cut, shared_dir, table
from . import matching as plans

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ sources and sinks
_RAW = "nullif(title, '') as title, nullif(url, '') as url, nullif(overview, '') as overview, nullif(job_details, '') as job_details, is_expired"


@_register(f"select {_RAW} from raw_jobs")
def csv_scan(s: SparkSession, d: str) -> DataFrame:
    """Crawled records appended to a CSV in two parts and read again: line breaks and quotes within fields come back."""
    path = _folder(s, "csv")
    raw = table(s, d, "raw_jobs")
    for part in (raw.where("title is null or title < 'K'"), raw.where("title >= 'K'")):
        files.append_csv(part.drop("loaded_at"), path, files.RAW_SCHEMA.names)
    return files.read_csv(s, path, files.RAW_SCHEMA).select(*[F.nullif(c, F.lit("")).alias(c) for c in ("title", "url", "overview", "job_details")], "is_expired")


@_register("select job_id, salary_min, is_expired, nullif(category, '') as category from jobs")
def csv_inferred(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "csv")
    files.append_csv(table(s, d, "jobs"), path, ["job_id", "salary_min", "is_expired", "category"])
    return files.read_csv(s, path).select(F.col("job_id").cast("bigint").alias("job_id"), F.col("salary_min").cast("double").alias("salary_min"), "is_expired", "category")


@_register("select cv_id, job_id, annotator, relevance_score, count(*) as n from annotations group by 1, 2, 3, 4")
def json_sheets(s: SparkSession, d: str) -> DataFrame:
    """Score sheets with their list of scores, one object a line, read back row by row; the sheet's annotator stands for a score's."""
    path = _folder(s, "json")
    a = table(s, d, "annotations")
    score = F.struct("cv_id", "cv_level", "cv_category", "job_id", "job_title", F.col("rank_no").alias("rank"), "es_score", "relevance_score", "skills_match", "experience_match", "education_match", "justification")
    a.select(F.struct("annotator").alias("metadata"), F.array(score).alias("annotations")).write.option("ignoreNullFields", "true").json(path)
    rows = files.read_score_sheets(s, path, one_per_file=False)
    return rows.groupBy("cv_id", "job_id", "annotator", "relevance_score").agg(F.count("*").alias("n"))


@_register(f"select event_id, ts, event_type from events order by ts desc nulls last, event_id limit {CONFIG.log_kept}")
def run_log(s: SparkSession, d: str) -> DataFrame:
    return files.retained_log(table(s, d, "events").select("event_id", "ts", "event_type"), "ts", CONFIG.log_kept, "event_id")


@_register("select address_id, (lat is null or isnan(lat) or lng is null or isnan(lng)) as is_missing from geocode_cache")
def missing_points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "geocode_cache").select("address_id", files.missing_point("lat", "lng").alias("is_missing"))


_NAME = "concat(coalesce(title, ''), case when job_id % 4 = 0 then '.PDF' when job_id % 4 = 1 then '.docx' when job_id % 4 = 2 then '.exe' else '' end)"


@_register(f"select job_id, (contains({_NAME}, '.') and regexp_matches({_NAME}, '(?i)\\.(pdf|doc|docx)$')) as is_allowed from jobs")
def allowed_files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "jobs").select("job_id", files.allowed_file(F.expr(_NAME)).alias("is_allowed"))


@_register("select job_id, title, company from jobs where job_id = (select min(job_id) from jobs)")
def point_lookup(s: SparkSession, d: str) -> DataFrame:
    least = table(s, d, "jobs").agg(F.min("job_id")).collect()[0][0]
    return table(s, d, "jobs").where(F.col("job_id") == F.lit(least)).select("job_id", "title", "company")


@_register(
    "with k as (select distinct url from raw_jobs where url is not null), h as (select url, content_hash, crawled_date, is_expired, job_id, row_number() over (partition by url order by crawled_date desc nulls last, job_id desc) as n from jobs where url is not null) "
    "select k.url, h.content_hash, h.crawled_date, h.is_expired, h.job_id from k left join h on h.url = k.url and n = 1"
)
def multi_get(s: SparkSession, d: str) -> DataFrame:
    """Five fields of the record held for each asked address, null where none is."""
    asked = table(s, d, "raw_jobs").select("url").where("url is not null").distinct()
    held = table(s, d, "jobs").where("url is not null").select("url", "content_hash", "crawled_date", "is_expired", "job_id")
    last = held.groupBy("url").agg(F.max_by(F.struct("content_hash", "crawled_date", "is_expired", "job_id"), F.struct("crawled_date", "job_id")).alias("h"))
    return asked.join(last, "url", "left").select("url", "h.*")


@_register("select vec_id, label from embeddings")
def without_vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").drop("embedding")


@_register("select true as has_vectors, count(*) as n_rows, count(embedding) as n_vectors from embeddings")
def vectors_available(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings")
    return v.agg(F.count("*").alias("n_rows"), F.count("embedding").alias("n_vectors")).select(F.lit(encoding.has_vectors(v, "embedding")).alias("has_vectors"), "n_rows", "n_vectors")


@_register("with t as (select unnest(regexp_extract_all(lower(coalesce(title, '')), '([\\p{L}\\p{N}]+)', 1)) as term, job_id from jobs) select count(distinct job_id) as n_docs, count(distinct term) as n_terms, count(*) as n_tokens from t")
def index_statistics(s: SparkSession, d: str) -> DataFrame:
    p = r.postings(table(s, d, "jobs"), "job_id", ["title"])
    return p.agg(F.count_distinct("doc").alias("n_docs"), F.count_distinct("term").alias("n_terms"), F.sum("tf").alias("n_tokens"))


# ------------------------------------------------------------------ taxonomy
_CROSS = """(select s_suppkey as row_no, upper(s_name) as title, 'c' || (s_suppkey % 25) as code from supplier
  union all select s_suppkey + 1000000000, ' ' || s_name || ' ', 'c' || s_nationkey from supplier where s_suppkey % 2 = 0)"""
_TOOLS = "(select 'c' || n_nationkey as code, n_name as tool from nation union all select 'c' || n_nationkey, 'area ' || n_regionkey from nation)"


@_register(
    f"with x as (select lower(trim(title)) as t, code, row_number() over (partition by lower(trim(title)) order by row_no desc) as n from {_CROSS}) "
    f"select distinct 'o' || s_suppkey as uri, x.code, tool from supplier join x on x.t = lower(s_name) and n = 1 join {_TOOLS} t on t.code = x.code"
)
def crosswalk_join(s: SparkSession, d: str) -> DataFrame:
    sup, nat = table(s, d, "supplier"), table(s, d, "nation")
    occ = sup.select(F.concat(F.lit("o"), "s_suppkey").alias("uri"), F.col("s_name").alias("title"))
    one = sup.selectExpr("s_suppkey as row_no", "upper(s_name) as title", "concat('c', s_suppkey % 25) as code")
    two = sup.where("s_suppkey % 2 = 0").selectExpr("s_suppkey + 1000000000 as row_no", "concat(' ', s_name, ' ') as title", "concat('c', s_nationkey) as code")
    tools = nat.selectExpr("concat('c', n_nationkey) as code", "n_name as tool").unionByName(nat.selectExpr("concat('c', n_nationkey) as code", "concat('area ', n_regionkey) as tool"))
    return taxonomy.crosswalk_tools(occ, one.unionByName(two), tools)


_NODES = """(select 's' || p_partkey as uri, p_name as title, 'SKILL' as type from part where p_partkey % 3 <> 0
  union all select 'v' || p_partkey, p_name || ' (software)', 'SKILL' from part where p_size < 10
  union all select 't' || p_partkey, upper(p_name), 'TOOL' from part)"""


@_register(
    f"""with n as (select lower(trim(title)) as form, uri, type, row_number() over (partition by lower(trim(title)) order by (type = 'TOOL'), uri) as k from {_NODES}),
a as (select distinct p_name as title from part union select 'No such thing'),
f as (select title, 0 as rank, lower(trim(title)) || ' (computer programming)' as form from a union all select title, 1, lower(trim(title)) || ' (software)' from a union all select title, 2, lower(trim(title)) from a),
m as (select title, uri, type, row_number() over (partition by title order by rank) as k from f join n using (form) where n.k = 1)
select a.title, m.uri, m.type from a left join m on m.title = a.title and m.k = 1"""
)
def title_resolution(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    node = lambda cond, *cols: part.where(cond).selectExpr(*cols)
    nodes = node("p_partkey % 3 <> 0", "concat('s', p_partkey) as uri", "p_name as title", "'SKILL' as type")
    nodes = nodes.unionByName(node("p_size < 10", "concat('v', p_partkey) as uri", "concat(p_name, ' (software)') as title", "'SKILL' as type"))
    nodes = nodes.unionByName(node("true", "concat('t', p_partkey) as uri", "upper(p_name) as title", "'TOOL' as type"))
    asked = part.select(F.col("p_name").alias("title")).unionByName(s.createDataFrame([("No such thing",)], "title string"))
    return taxonomy.resolved_titles(asked, nodes)


@_register(f"select type, count(*) as n from {_NODES} group by 1")
def node_counts(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    kinds = F.array_compact(F.array(F.when(F.col("p_partkey") % 3 != 0, "SKILL"), F.when(F.col("p_size") < 10, "SKILL"), F.lit("TOOL")))
    return part.select(F.explode(kinds).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


#: Short keys of categories.
CATEGORY_KEYS = {
    "Nhân viên kinh doanh": "kinh_doanh", "Kế toán": "ke_toan", "Marketing": "marketing", "Hành chính nhân sự": "hanh_chinh_nhan_su", "Chăm sóc khách hàng": "cham_soc_khach_hang", "Ngân hàng": "ngan_hang", "IT": "it",
    "Lao động phổ thông": "lao_dong_pho_thong", "Kỹ sư xây dựng": "ky_su_xay_dung", "Thiết kế đồ họa": "thiet_ke_do_hoa", "Bất động sản": "bat_dong_san", "Giáo dục": "giao_duc", "Telesales": "telesales",
}
_KEYS = "(values " + ", ".join(f"('{k}', '{v}')" for k, v in CATEGORY_KEYS.items()) + ") as k(category, category_key)"


@_register(f"select job_id, jobs.category, category_key from jobs left join {_KEYS} on k.category = jobs.category")
def category_keys(s: SparkSession, d: str) -> DataFrame:
    keys = s.createDataFrame(list(CATEGORY_KEYS.items()), "category string, category_key string")
    return table(s, d, "jobs").select("job_id", "category").join(F.broadcast(keys), "category", "left").select("job_id", "category", "category_key")  # a short list


@_register(f"select category_key, count(*) as n from ({ORACLE['category_keys']}) where category_key is not null group by 1")
def category_names(s: SparkSession, d: str) -> DataFrame:
    return category_keys(s, d).where("category_key is not null").groupBy("category_key").agg(F.count("*").alias("n"))


@_register("select job_id, list_extract(string_split(url, '/'), -1) as tail from jobs")
def uri_tail(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "jobs").select("job_id", taxonomy.uri_tail(F.col("url")).alias("tail"))


def _label_sql(x: str) -> str:
    """The first label of a text: words up to the first that comes again, four of six, all of three."""
    return f"""(select case when len(w) <= 3 then trim({x}) when again is not null and again <= 6 then array_to_string(list_slice(w, 1, again - 1), ' ') when len(w) >= 6 then array_to_string(list_slice(w, 1, 4), ' ') else array_to_string(w, ' ') end
      from (select w, list_filter(range(2, len(w) + 1), lambda i: list_position(f, f[i]) < i)[1] as again from (select w, list_transform(w, lambda y: trim(lower(y), '.,;:')) as f from (select list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda y: y <> '') as w))))"""


@_register(
    rf"""with t as (select job_id, trim(coalesce(job_requirements, '')) as t from jobs),
p as (select job_id, t, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as p from t),
b as (select *, coalesce(list_filter(range(1, len(p) + 1), lambda i: length(trim(p[i])) > 40 and regexp_matches(trim(p[i]), '^\p{{Lu}}') and (contains(trim(p[i]), '.') or length(trim(p[i])) > 80))[1], len(p)) as k from p),
s as (select job_id, t, len(p) <= 1 as one, array_to_string(list_slice(p, k, len(p)), '. ') as description, case when k > 1 then array_to_string(list_slice(p, 1, k - 1), '. ') else '' end as labels from b),
l as (select job_id, case when one then '' else labels end as labels, case when one then t else description end as description, case when one then t else labels end as source from s)
select job_id, labels, description, {_label_sql('l.source')} as preferred from l"""
)
def label_split(s: SparkSession, d: str) -> DataFrame:
    return taxonomy.split_descriptions(table(s, d, "jobs"), "job_id", "job_requirements")


_CONCEPT = """concat('{"title":"', p_name, '","alternativeLabel":{"en":', case p_partkey % 3 when 0 then concat('["', p_brand, '","', p_type, '"]') when 1 then concat('"', p_brand, '"') else 'null' end,
'},"_links":{"hasSkillType":[', case when p_size < 25 then concat('{"title":"', p_type, '"}') else '' end, ']},"description":{"en":{"literal":"', p_type, ' of ', p_name, '"}}}')"""


@_register(
    "select p_partkey, p_name as preferred_label, case p_partkey % 3 when 0 then p_brand || ' | ' || p_type when 1 then p_brand else '' end as alt_labels, case when p_size < 25 then p_type else '' end as skill_type, p_type || ' of ' || p_name as description_en from part"
)
def concept_json(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "part").select("p_partkey", F.expr(_CONCEPT).alias("reply"))
    return t.select("p_partkey", *[c.alias(n) for n, c in taxonomy.concept_fields(F.col("reply")).items()])


_BARE = "trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
_HEAD = "'<title>Tin ' || doc_id || '</title><meta name=\"description\" content=\"' || coalesce(category, '') || '\"><h' || (1 + doc_id % 2) || ' class=\"x\">' || coalesce(company, '') || '</h' || (1 + doc_id % 2) || '>' || coalesce(text, '')"


def _first_sql(p: str) -> str:
    return _BARE.format(f"regexp_extract(page, '{p}', 1)")


@_register(
    f"""with d as (select doc_id, {_HEAD} as page from documents)
select doc_id, {_first_sql('(?is)<title[^>]*>(.*?)</title>')} as page_title, coalesce(nullif({_first_sql('(?is)<h1[^>]*>(.*?)</h1>')}, ''), {_first_sql('(?is)<h2[^>]*>(.*?)</h2>')}) as heading,
  {_first_sql('(?is)<meta[^>]*name=["'']description["''][^>]*content=["'']([^"'']*)["'']')} as described, len(regexp_extract_all(page, '(?i)<a\\s[^>]*href=')) as n_links, length({_BARE.format('page')}) as n_bare from d"""
)
def page_fields(s: SparkSession, d: str) -> DataFrame:
    """Fields of pages; the documents' texts are put below a page's head, as most of them have none."""
    pages = table(s, d, "documents").select("doc_id", F.expr(_HEAD).alias("page"))
    got = taxonomy.page_fields(F.col("page"))
    return pages.select("doc_id", *[got[n].alias(n) for n in ("page_title", "heading", "described", "n_links")], F.length(got["bare_text"]).alias("n_bare"))


# ------------------------------------------------------------------ texts and scores
_TAGS = """t as (select url, overview, row_number() over (partition by url order by loaded_at desc nulls last, content_hash desc nulls last) as n from raw_jobs where url is not null)"""


@_register(
    rf"""with {_TAGS},
o as (select url, regexp_extract(coalesce(overview, ''), '(?s)Chuyên môn[:\s]*\n(.*?)(?:\n===|\n\n===|\z)', 1) as a, regexp_extract(coalesce(overview, ''), '(?s)Yêu cầu[:\s]*\n(.*?)(?:\nQuyền lợi:|\nChuyên môn:|\n===|\z)', 1) as b from t where n = 1),
g as (select url, array_to_string(list_filter(list_transform(string_split(a, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ', ') as tags, array_to_string(list_filter(list_transform(string_split(b, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ', ') as specs from o)
select job_id, concat_ws('. ', nullif(trim(title), ''), nullif(tags, ''), nullif(trim(technical_skills), ''), nullif(specs, ''), nullif(substr(trim(job_requirements), 1, 500), '')) as body from jobs left join g using (url)"""
)
def job_text_assembly(s: SparkSession, d: str) -> DataFrame:
    """Five fields; the tags come from the overview of the last crawl of the advert's address."""
    last = table(s, d, "raw_jobs").where("url is not null").groupBy("url").agg(F.max_by("overview", F.struct("loaded_at", "content_hash")).alias("overview"))
    tags = last.select("url", column(records.requirement_tags(SPARK, "overview")).alias("tags"), column(records.specialisations(SPARK, "overview")).alias("specs"))
    j = table(s, d, "jobs").join(tags, "url", "left")
    return j.select("job_id", encoding.job_text(*map(F.col, ("title", "tags", "technical_skills", "specs", "job_requirements"))).alias("body"))


@_register("select cv_id, concat_ws('. ', nullif(trim(skills), ''), nullif(trim(cv_markdown), '')) as body from cv_profiles")
def cv_text_assembly(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "cv_profiles").select("cv_id", encoding.cv_text(F.col("skills"), F.col("cv_markdown")).alias("body"))


@_register(plans._FULL_TEXT.replace("cv_id as query", "cv_id").replace(" where trim(skills) <> ''", ""))
def retrieval_text(s: SparkSession, d: str) -> DataFrame:
    extras = [F.col(c) for c in ("soft_skills", "languages", "certificates", "education", "experience")]
    return table(s, d, "cv_profiles").select("cv_id", encoding.retrieval_text(F.col("skills"), extras, F.col("suggested_categories")).alias("txt"))


@_register(
    """select job_id, '[JOB ' || (job_id % 5 + 1) || '] ' || coalesce(title, '') || chr(10) || 'Ngành: ' || coalesce(category, '') || ' | Lĩnh vực: ' || coalesce(company_field, '') || chr(10)
|| 'Lương: ' || coalesce(job_salary, '') || ' | Địa điểm: ' || coalesce(job_location, '') || ' | Kinh nghiệm: ' || coalesce(experience, '') || chr(10) || 'Học vấn: ' || coalesce(education_level, '') || chr(10)
|| 'Kỹ năng: ' || coalesce(technical_skills, '') || chr(10) || 'Mô tả: ' || substr(coalesce(job_description, ''), 1, 350) || chr(10) || 'Yêu cầu: ' || substr(coalesce(job_requirements, ''), 1, 800) as prompt from jobs"""
)
def job_prompts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "jobs").select("job_id", scoring.job_prompt(F.col, F.col("job_id") % 5 + 1).alias("prompt"))


_LINE = "case when trim(coalesce({c}, '')) <> '' then '{l}' || {c} end"


@_register(
    "with c as (select *, case education when 'dai_hoc' then 'Đại học' when 'cao_dang' then 'Cao đẳng' when 'trung_cap' then 'Trung cấp' when 'trung_hoc' then 'Trung học' else education end as edu, "
    "case experience when 'no_requirement' then 'Chưa có' when 'under_1' then 'Dưới 1 năm' when 'over_5' then 'Trên 5 năm' when 'all' then 'Không giới hạn' when '1' then '1 năm' when '2' then '2 năm' when '3' then '3 năm' when '4' then '4 năm' when '5' then '5 năm' else experience end as ex, "
    "substr(trim(cv_markdown), 1, 6000) as md from cv_profiles) select cv_id, concat_ws(chr(10), "
    + ", ".join(_LINE.format(c=c, l=x) for c, x in (("skills", "Kỹ năng chuyên môn: "), ("soft_skills", "Kỹ năng mềm: "), ("languages", "Ngoại ngữ: "), ("certificates", "Chứng chỉ: "), ("ex", "Kinh nghiệm: "), ("edu", "Học vấn: "), ("cv_location", "Địa điểm: "), ("md", "")))
    + ") as prompt from c"
)
def cv_prompts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "cv_profiles").select("cv_id", scoring.cv_prompt(F.col).alias("prompt"))


_UNION_REPLY = "concat('{{\"skills\": ', case when job_id % 2 = 0 then concat('[\"', regexp_replace(coalesce(category, ''), '[^a-zA-Z ]', ''{g}), '\", \"SQL\"]') else '{{\"technical\": [\"Word\"], \"soft\": null, \"languages\": \"Anh\"}}' end, '}}')"


@_register(
    f"with t as (select job_id, ({_UNION_REPLY.format(g=', ' + chr(39) + 'g' + chr(39))})::json as j from jobs) select job_id, case when json_type(j->'skills') = 'ARRAY' then array_to_string(from_json(j->'skills', '[\"VARCHAR\"]'), ', ') else 'Word' end as technical, "
    "'' as soft, case when json_type(j->'skills') = 'ARRAY' then '' else 'Anh' end as languages, '' as certificates from t"
)
def skills_list_or_groups(s: SparkSession, d: str) -> DataFrame:
    """Skills of a reply that gives them as one list, or in groups of which each is a list, a text or nothing."""
    x = F.get_json_object(F.expr(_UNION_REPLY.format(g="")), "$.skills")
    t = table(s, d, "jobs").select("job_id", x.alias("x"))
    listed = F.col("x").startswith("[")
    text = lambda v: F.coalesce(F.when(v.startswith("["), F.array_join(F.from_json(v, "array<string>"), ", ")).otherwise(v), F.lit(""))
    group = lambda n: F.when(listed, text(F.col("x")) if n == "technical" else F.lit("")).otherwise(text(F.get_json_object("x", f"$.{n}")))
    return t.select("job_id", *[group(n).alias(n) for n in ("technical", "soft", "languages", "certificates")])


@_register(
    f"{plans._LEX}, h as (select query, doc, rank from ({plans._LEX_HITS}) where rank <= 20), sc as (select query, doc, rank, round(1.0::double * rank / 4, 4) as score from h where rank <= length(query) + 5) "
    "select h.query, h.doc, h.rank as place, coalesce(sc.score, 5.0::double) as score from h left join sc on sc.query = h.query and sc.rank = h.rank"
)
def attached_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores brought to their adverts by place; the list of scores is shorter than that of the adverts, the rest gets the middle."""
    hits = plans._lexical(s, d, CONFIG.msm, 20).select("query", "doc", F.col("rank").alias("place"))
    short = hits.where(F.col("place") <= F.length("query") + 5).select("query", "place", F.round(F.col("place").cast("double") / 4, 4).alias("score"))
    return scoring.attached(hits, short).select("query", "doc", "place", "score")


_HITS20 = f"select query, doc from ({plans._LEX_HITS}) where rank <= 20"


@_register(
    f"""{plans._LEX}, {plans._pair_sql(_HITS20)},
pt as (select job_location, min((latitude, longitude)) as p from jobs where latitude is not null and longitude is not null group by 1),
g as (select company_address, min((lat, lng)) as p from geocode_cache where lat is not null and lng is not null group by 1),
b as (select p.query, p.doc, trim(coalesce(c.cv_address, c.cv_location, '')) <> '' as has_address, pt.p[1] as a, pt.p[2] as o, j.latitude, j.longitude, g.p[1] as glat, g.p[2] as glng,
  {geo.city_score(plans.CHECK, 'p.cv_cities', 'p.job_cities', CONFIG.same_city, CONFIG.other_city, CONFIG.unknown_city)} as cs
  from pairs p join cv_profiles c on c.cv_id = p.query join jobs j on j.job_id = p.doc left join pt on pt.job_location = c.cv_location left join g on g.company_address = j.company_address),
k as (select *, least(case when a + latitude + longitude is not null then {geo.distance_km('a', 'o', 'latitude', 'longitude')} end, case when a + glat is not null then {geo.distance_km('a', 'o', 'glat', 'glng')} end) as km0 from b),
m as (select *, case when has_address then km0 end as km from k)
select query, doc, round(km, 3) as km, case when not has_address then {CONFIG.unknown_city}::double when km is not null then round(greatest({CONFIG.location_floor}::double, 10 * exp(-km / {CONFIG.distance_km}::double)), 1) else cs end as score from m"""
)
def nearest_branch(s: SparkSession, d: str) -> DataFrame:
    """Profiles to the branches of retrieved adverts: the advert's own point and that of its address; a profile's point is one of its city."""
    hits = plans._lexical(s, d, CONFIG.msm, 20).select("query", "doc")
    pairs = plans._with_columns(s, d, hits).select("query", "doc", column(geo.city_score(SPARK, "cv_cities", "job_cities", CONFIG.same_city, CONFIG.other_city, CONFIG.unknown_city)).alias("city_score"))
    j, g = table(s, d, "jobs"), table(s, d, "geocode_cache")
    at = lambda df, key, a, b: df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(a).alias("lat"), F.col(b).alias("lng"))).alias("p"))
    cv = table(s, d, "cv_profiles").select(F.col("cv_id").alias("query"), F.col("cv_location").alias("job_location"), (F.trim(F.coalesce("cv_address", "cv_location", F.lit(""))) != "").alias("has_address"))
    cv = cv.join(at(j, "job_location", "latitude", "longitude"), "job_location", "left").select("query", "has_address", F.col("p").alias("point"))
    own = j.select(F.col("job_id").alias("doc"), "company_address", F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lng")).alias("own"))
    own = own.join(at(g, "company_address", "lat", "lng"), "company_address", "left").select("doc", F.array_compact(F.array("own", "p")).alias("branches"))
    return matching.nearest_branch(pairs.join(cv, "query").join(own, "doc"))


@_register(
    f"""{plans._LEX}, {plans._pair_sql(plans._LEX_HITS)}, sc as (select query, doc, {plans._RUBRIC} from pairs)
select query, doc, location, round(sc.relevance * w('relevance') + sc.skills * w('skills') + sc.experience * w('experience') + sc.education * w('education') + sc.salary * w('salary') + sc.location * w('location'), 2) as total
from sc join cv_profiles c on c.cv_id = sc.query""".replace("w('relevance')", "coalesce(weights['relevance'], case when weights is null then 0.25 else 0 end)")
    .replace("w('skills')", "coalesce(weights['skills'], case when weights is null then 0.3 else 0 end)")
    .replace("w('experience')", "coalesce(weights['experience'], case when weights is null then 0.15 else 0 end)")
    .replace("w('education')", "coalesce(weights['education'], case when weights is null then 0.1 else 0 end)")
    .replace("w('salary')", "coalesce(weights['salary'], case when weights is null then 0.1 else 0 end)")
    .replace("w('location')", "coalesce(weights['location'], case when weights is null then 0.1 else 0 end)")
)
def location_override(s: SparkSession, d: str) -> DataFrame:
    """The total with the location by cities in the place of the model's, weighed as the profile wishes."""
    sc = plans.rubric_scores(s, d)
    w = table(s, d, "cv_profiles").select(F.col("cv_id").alias("query"), "weights")
    return scoring.with_location(sc.join(w, "query"), F.col("location"), F.col("weights")).select("query", "doc", "location", "total")


@_register(r"""select cv_id, length(trim(coalesce(cv_markdown, ''))) >= 50 as success, case when length(trim(coalesce(cv_markdown, ''))) < 50 then 'short' end as error,
  case when length(trim(coalesce(cv_markdown, ''))) >= 50 then regexp_replace(regexp_extract(cv_markdown, '(?s)^##+[ ]*Tóm tắt[ ]*\n(.*?)(?:\n##|\z)', 1), '^\s+|\s+$', '', 'g') else '' end as experience,
  substr(coalesce(cv_markdown, ''), 1, case when length(trim(coalesce(cv_markdown, ''))) < 50 then 500 else 8000 end) as raw_text from cv_profiles""")
def parsed_cvs(s: SparkSession, d: str) -> DataFrame:
    got = scoring.parsed_profiles(table(s, d, "cv_profiles"), "cv_id", "cv_markdown", [scoring.heading_parser({"tóm tắt": "experience", "kỹ năng": "technical_skills", "học vấn": "education"})])
    return got.select("cv_id", "success", "error", "experience", "raw_text")


# ------------------------------------------------------------------ pages, samples, keys
@_register("select job_id, title from jobs order by try_strptime(crawled_date, '%Y-%m-%d %H:%M:%S') desc nulls last, job_id limit 100")
def browse_clamped(s: SparkSession, d: str) -> DataFrame:
    """Page 0 is the first, and a page has 100 rows at most."""
    return api.browse(table(s, d, "jobs"), page=0, size=500).select("job_id", "title")


@_register(f"select query, doc, rank from ({plans.ORACLE['multi_match_best_fields'].replace('rank <= 10', f'rank <= {CONFIG.response_cap}')})")
def response_cap(s: SparkSession, d: str) -> DataFrame:
    return plans._lexical(s, d, CONFIG.msm, CONFIG.response_cap).select("query", "doc", "rank")


@_register("select job_id, row_number() over (order by md5(job_id || ':42'), job_id) as place from jobs qualify place <= 100")
def shuffled_sample(s: SparkSession, d: str) -> DataFrame:
    """A hundred adverts in a shuffled order that repeats: the limit is the feature."""
    return api.shuffled(table(s, d, "jobs").select("job_id"), "job_id", 42, 100)


@_register("with p as (select job_id, job_location, md5(job_id || ':42') as k from jobs order by k, job_id limit 100) select count(*) as n, sum(case when city is not null then 1 else 0 end)::bigint as n_right, round(avg(case when city is not null then 1.0::double else 0 end), 6) as accuracy from p left join city_ref on city = job_location")
def sample_accuracy(s: SparkSession, d: str) -> DataFrame:
    """Of a hundred sampled adverts, how many state a city letter for letter as it is listed."""
    sample = api.shuffled(table(s, d, "jobs").select("job_id", "job_location"), "job_id", 42, 100)
    known = table(s, d, "city_ref").select(F.col("city").alias("job_location"), F.lit(True).alias("is_right")).distinct()
    return reports.accuracy(sample.join(F.broadcast(known), "job_location", "left").withColumn("is_right", F.coalesce("is_right", F.lit(False))), "is_right")  # a short list


@_register("select job_id, coalesce(nullif(content_hash, ''), regexp_replace(coalesce(url, ''), '[?#].*$', '')) as dedup_key from jobs")
def dedup_key(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "jobs").select("job_id", F.coalesce(F.nullif("content_hash", F.lit("")), column(records.canonical_url(SPARK, "url"))).alias("dedup_key"))


@_register("with k as (select distinct coalesce(nullif(content_hash, ''), regexp_replace(coalesce(url, ''), '[?#].*$', '')) as key from raw_jobs) select key from k where key <> '' and key not in (select coalesce(nullif(content_hash, ''), regexp_replace(coalesce(url, ''), '[?#].*$', '')) from jobs)")
def resume_pending(s: SparkSession, d: str) -> DataFrame:
    """What a run that was cut short has still to do: raw records whose key isn't among those done."""
    key = F.coalesce(F.nullif("content_hash", F.lit("")), column(records.canonical_url(SPARK, "url"))).alias("key")
    return table(s, d, "raw_jobs").select(key).distinct().where("key <> ''").join(table(s, d, "jobs").select(key).distinct(), "key", "left_anti")


@_register(
    """with l as (select canonical, lvl, job_id from (select job_id, regexp_replace(coalesce(url, ''), '[?#].*$', '') as canonical, case experience when 'Không yêu cầu' then 1 when 'Dưới 1 năm' then 2 when '1 năm' then 3 when '2 năm' then 4 when '3 năm' then 5 when '4 năm' then 6 when '5 năm' then 7 when 'Trên 5 năm' then 8 end as lvl from jobs))
select job_id, case when job_id % 3 < 1 then canonical else canonical || '?page=' || (job_id % 3 + 1) end as paged,
  canonical || '?exp=' || lvl || '&type_keyword=1&sba=1&saturday_status=0' || case when job_id % 2 = 0 then '&category_family=f' || (job_id % 7) else '' end || case when job_id % 3 > 0 then '&page=' || (job_id % 3 + 1) else '' end as filtered,
  canonical || '?exp=' || lvl || '&sort=up_top&type_keyword=1&sba=1&saturday_status=0' || case when job_id % 3 > 0 then '&page=' || (job_id % 3 + 1) else '' end as newest from l"""
)
def listing_url(s: SparkSession, d: str) -> DataFrame:
    """Addresses of listing pages: paged only; by experience and, where there is one, family of categories; by experience, newest first."""
    base, page = column(records.canonical_url(SPARK, "url")), F.col("job_id") % 3 + 1
    family = F.when(F.col("job_id") % 2 == 0, F.concat(F.lit("f"), F.col("job_id") % 7))
    level = column(records.experience_level(SPARK, "experience"))
    j = table(s, d, "jobs")
    return j.select("job_id", records.paged_url(base, page).alias("paged"), records.filtered_url(base, level, page, family=family).alias("filtered"), records.filtered_url(base, level, page, newest=True).alias("newest"))


_DIMS = ["relevance_score", "skills_match", "experience_match", "education_match"]


@_register(
    "with l as (" + " union all ".join(f"select cv_id, job_id, cv_category, cv_level, '{x}' as dimension, {x} as score from annotations where {x} between 0 and 10" for x in _DIMS) + f"), s as (select cv_id, job_id, dimension, min(cv_category) as cv_category, min(cv_level) as cv_level, max(score) - min(score) as spread from l group by 1, 2, 3) "
    f"select dimension, cv_category, cv_level, count(*) as n_items from s where spread > {CONFIG.disagreement} group by 1, 2, 3"
)
def disagreement_groups(s: SparkSession, d: str) -> DataFrame:
    """High disagreement by dimension, category and level."""
    return reports.disagreement(table(s, d, "annotations"), ["cv_id", "job_id"], _DIMS, CONFIG.disagreement, by=["cv_category", "cv_level"])


@_register(
    f"""with near as (select q.vec_id as query, c.vec_id as doc, round((1 + list_cosine_similarity(q.embedding::double[], c.embedding::double[])) / 2, 6) as score, row_number() over (partition by q.vec_id order by round((1 + list_cosine_similarity(q.embedding::double[], c.embedding::double[])) / 2, 6) desc, c.vec_id) as n from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
ok as (select query, doc, n from near where n <= 5 and 2 * score - 1 >= {CONFIG.min_similarity}),
parts as (select query, 0 as part, 0 as a, 0 as b, 'v' || query as term from near where n = 1 union all select query, 1, n, 1, 'v' || doc from ok union all select query, 1, n, 2, 'label ' || label from ok join embeddings on vec_id = doc),
f as (select query, term, min((part, a, b)) as o from parts group by 1, 2)
select query, term, place from (select query, term, row_number() over (partition by query order by o, term) as place from f) where place <= {CONFIG.vector_cap}"""
)
def expand_by_vectors(s: SparkSession, d: str) -> DataFrame:
    """A term, then two other labels of each of its five nearest concepts that are near enough; thirty terms at most, none twice."""
    v = table(s, d, "embeddings")
    near = r.nearest(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit(0).alias("tag")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit(0).alias("tag")), 5)
    labels = v.select(F.col("vec_id").alias("doc"), F.array(F.concat(F.lit("v"), "vec_id"), F.concat(F.lit("label "), "label")).alias("alts"))
    return expansion.expand_near(near, labels, CONFIG.min_similarity, CONFIG.vector_cap)


# ------------------------------------------------------------------ without SQL
@_register()
def semantic_match(s: SparkSession, d: str) -> DataFrame:
    """The whole match with vectors of the texts themselves, by the hashing encoder."""
    return api.match(table(s, d, "cv_profiles"), table(s, d, "jobs"), table(s, d, "city_ref"))


@_register()
def scored_batches(s: SparkSession, d: str) -> DataFrame:
    """A stand-in for a model that reads prompts: shared words; it fails for profiles of one category, whose adverts fall back."""
    hits = plans._lexical(s, d, CONFIG.msm, 30).select("query", "doc", F.col("rank").alias("place"))
    cv = table(s, d, "cv_profiles").select(F.col("cv_id").alias("query"), scoring.cv_prompt(F.col).alias("profile"))
    job = table(s, d, "jobs").join(cut(hits).select(F.col("doc").alias("job_id")).distinct(), "job_id", "left_semi").select(F.col("job_id").alias("doc"), scoring.job_prompt(F.col, F.lit(1)).alias("job"))

    def shared_words(profile: str, jobs):
        if "Lãnh đạo" in profile:
            raise RuntimeError("no answer")
        own = set(profile.lower().split())
        return [{k: len(own & set(j.lower().split())) // 3 for k in scoring.DIMENSIONS} for j in jobs]

    return scoring.scored_pairs(hits.join(cv, "query").join(job, "doc"), shared_words)
