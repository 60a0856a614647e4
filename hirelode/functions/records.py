"""Fields of advert records: cleaning, extraction, classification, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import Spark, has_any, text

LEVELS = ["Đại học", "Cao đẳng", "Trung cấp", "Trung học", "Không yêu cầu"]
#: Other wordings of a level, and words that speak of commission.
LEVEL_WORDS = [("trung học phổ thông", "Trung học"), ("cấp 3", "Trung học"), ("thpt", "Trung học"), ("trung cấp nghề", "Trung cấp"), ("cao đẳng nghề", "Cao đẳng")]
COMMISSION = ["hoa hồng", "thưởng doanh số", "commission", "% dự án", "kpi", "thu nhập không giới hạn", "thuong doanh so", "hoa hong"]
#: Titles that are no titles.
NO_TITLES = ["trang chủ", "tin tuyển dụng", "tuyển dụng", "việc làm", "tìm việc làm", "404", "not found", "error", "access denied", "forbidden"]
SECTIONS = {"job_description": "MÔ TẢ CÔNG VIỆC", "job_requirements": "YÊU CẦU ỨNG VIÊN", "job_benefits": "QUYỀN LỢI", "working_time": "THỜI GIAN LÀM VIỆC"}
#: Genders an advert may ask of a profile of each gender.
NEUTRAL = ["Không yêu cầu", "không yêu cầu", "Khong yeu cau", "khong yeu cau", "Cả hai", "cả hai", "Ca hai", "ca hai", "Tất cả", "tất cả", "Tat ca", "tat ca", "Nam/Nữ", "Nam / Nữ", "Nam, Nữ", "Nam và Nữ", "both", "all", ""]
GENDERS = {"male": (["nam", "male"], ["Nam", "nam", "Male", "male"]), "female": (["nữ", "nu", "female"], ["Nữ", "nữ", "Nu", "nu", "Female", "female"])}
ANY_GENDER = ["", "both", "all", "tất cả", "tat ca", "không rõ", "khong ro"]
EDUCATION_CODES = {"dai_hoc": "Đại học", "cao_dang": "Cao đẳng", "trung_cap": "Trung cấp", "trung_hoc": "Trung học"}
EXPERIENCE_CODES = {"no_requirement": "Chưa có", "under_1": "Dưới 1 năm", "1": "1 năm", "2": "2 năm", "3": "3 năm", "4": "4 năm", "5": "5 năm", "over_5": "Trên 5 năm", "all": "Không giới hạn"}


def clean_text(q: Spark, x: str) -> str:
    """No-break and zero-width spaces dropped, then trimmed, then runs of blanks made one."""
    bare = f"replace(replace(coalesce({x}, ''), ' ', ''), '​', '')"
    return q.repl(q.repl(bare, r"^\s+|\s+$"), r"\s+", " ")


def boolean(q: Spark, x: str) -> str:
    return f"coalesce(lower(trim(CAST({x} AS varchar({10})))) IN ('true', '1', 'yes'), false)".replace("varchar(10)", "string" if type(q) is Spark else "varchar")


def millions(q: Spark, x: str) -> str:
    """An amount in VND or millions as millions: above 1000 it is VND."""
    v = q.double(x)
    return f"CASE WHEN {v} > 1000 THEN {v} / 1000000 ELSE {v} END"


def section(q: Spark, x: str, header: str) -> str:
    """The text between ``=== header ===`` and the next header."""
    body = q.ext(f"coalesce({x}, '') || chr(10) || '==='", rf"(?s)===\s*{header}\s*===\s*\n(.*?)\n===", 1)
    return q.repl(body, r"^\s+|\s+$")


def overview_tags(q: Spark, x: str, header: str, ends: str) -> str:
    """The lines below ``header`` in an overview up to one of ``ends``, joined by commas."""
    body = q.ext(f"coalesce({x}, '')", rf"(?s){header}[:\s]*\n(.*?)(?:{ends}|\z)", 1)
    lines = q.filter(q.map(q.split(body, r"\n"), "l", "trim(l)"), "l", "l <> ''")
    return q.join(lines, ", ")


def requirement_tags(q: Spark, x: str) -> str:
    return overview_tags(q, x, "Chuyên môn", r"\n===|\n\n===")


def specialisations(q: Spark, x: str) -> str:
    return overview_tags(q, x, "Yêu cầu", r"\nQuyền lợi:|\nChuyên môn:|\n===")


#: Elements one of which every page of an advert has, as tag and class.
PAGE_MARKERS = [
    ("div", "job-detail__body"), ("div", "job-description"), ("div", "job-detail__info--title"), ("h1", "job-detail__info--title"), ("h1", "job-title"),
    ("div", "content-tab"), ("div", "brand-body"), ("div", "box-info"), ("h2", "title"),
]


def blocked_page(q: Spark, x: str, least: int) -> str:
    """Whether a page is shorter than ``least`` or has none of the elements of an advert."""
    t = f"coalesce({x}, '')"
    found = " OR ".join(q.match(t, rf"<{tag}\b[^>]*\bclass\s*=\s*[\"'](?:[^\"']*\s)?{name}(?:\s[^\"']*)?[\"']") for tag, name in PAGE_MARKERS)
    return f"(length({t}) < {least} OR NOT ({found}))"


def quality_gate(q: Spark, overview_least: int, details_least: int = 50) -> str:
    """Whether a raw record is complete: title, overview with experience, details, description and requirements."""
    described = f"length({section(q, 'job_details', SECTIONS['job_description'])})"
    asked = f"length({section(q, 'job_details', SECTIONS['job_requirements'])})"
    stated = q.match(f"coalesce(overview, {q.lit('')})", r"Kinh nghiệm[:\s]*\n?\s*[^\n]")
    return f"(trim(coalesce(title, '')) <> '' AND length(coalesce(overview, '')) >= {overview_least} AND length(coalesce(job_details, '')) >= {details_least} AND {stated} AND {described} >= 30 AND {asked} >= 10)"


def overview_experience(q: Spark, x: str) -> str:
    return f"trim({q.ext(f'coalesce({x}, {q.lit(str())})', r'Kinh nghiệm[:\s]*([^\n]+)')})"


def gender(q: Spark, title: str, stated: str, requirements: str) -> str:
    """From the title, else a valid stated value, else the first 30 letters of the requirements."""
    t, s, r = f"lower(coalesce({title}, ''))", f"trim(coalesce({stated}, ''))", f"substr(lower(coalesce({requirements}, '')), 1, 30)"
    end = r"(?:[^\p{L}\p{N}_]|$)"
    return (
        f"CASE WHEN {q.match(t, r'[-–(]\s*nữ' + end)} THEN 'Nữ' WHEN {q.match(t, r'[-–(]\s*nam' + end)} THEN 'Nam' "
        f"WHEN {s} IN ('Nam', 'Nữ', 'Không yêu cầu') THEN {s} WHEN contains({r}, 'nữ') AND NOT contains({r}, 'nam') THEN 'Nữ' "
        f"WHEN contains({r}, 'nam') AND NOT contains({r}, 'nữ') THEN 'Nam' ELSE 'Không yêu cầu' END"
    )


def education(q: Spark, x: str) -> str:
    t = f"lower({text(q, x)})"
    rules = " ".join(f"WHEN contains({t}, {q.lit(v.lower())}) THEN {q.lit(v)}" for v in LEVELS)
    rules += " " + " ".join(f"WHEN contains({t}, {q.lit(w)}) THEN {q.lit(v)}" for w, v in LEVEL_WORDS)
    return f"CASE {rules} ELSE '' END"


def commission(q: Spark, flag: str, *fields: str) -> str:
    """The flag, or where it is missing whether the texts speak of commission."""
    t = "lower(concat_ws(' ', " + ", ".join(f"coalesce({f}, '')" for f in fields) + "))"
    return f"coalesce({flag}, {has_any(q, t, COMMISSION)})"


def tier(q: Spark, x: str, first_year: str = "mid") -> str:
    """``junior, mid`` or ``senior`` by ordered substring rules; ``first_year``: the tier of "1 năm"."""
    t = f"lower(coalesce({x}, ''))"
    n = q.double(f"nullif({q.ext(t, r'(\d+)')}, '')")
    c = lambda w: f"contains({t}, {q.lit(w)})"
    return (
        f"CASE WHEN {t} = '' OR {c('không yêu cầu')} OR {c('chưa')} OR {c('dưới 1')} OR {c('under')} THEN 'junior' "
        f"WHEN {c('1 năm')} AND NOT {c('10')} THEN '{first_year}' WHEN {c('2 năm')} OR {c('3 năm')} THEN 'mid' "
        f"WHEN {c('4 năm')} OR {c('5 năm')} OR {c('trên 5')} OR {c('over')} THEN 'senior' "
        f"WHEN {n} > 3 THEN 'senior' WHEN {n} > 1 THEN 'mid' ELSE 'junior' END"
    )


def canonical_url(q: Spark, x: str) -> str:
    return q.repl(f"coalesce({x}, '')", r"[?#].*$")


def valid_url(q: Spark, x: str) -> str:
    """A listing's page: a slug and a number, or a brand's page of its own."""
    return f"coalesce({q.match(x, r'^https://[^/]+/viec-lam/[^/]+/\d+\.html|^https://[^/]+/brand/[^/]+/tuyen-dung/.+-j\d+\.html')}, false)"


def valid_title(q: Spark, x: str) -> str:
    t = f"lower(trim(coalesce({x}, '')))"
    deny = ", ".join(q.lit(w) for w in NO_TITLES)
    return f"(length({t}) >= 3 AND {t} NOT IN ({deny}) AND NOT {q.match(t, r'^(http|www\.)')})"


def content_key(q: Spark, *fields: str) -> str:
    return "md5(" + " || '|' || ".join(f"coalesce({f}, '')" for f in fields) + ")"


def deadline_in(q: Spark, x: str) -> str:
    return q.ext(f"coalesce({x}, '')", r"Hạn nộp[^:]*:\s*(\d{1,2}/\d{1,2}/\d{4})")


def expired(q: Spark, deadline: str, as_of: str) -> str:
    """A deadline's day itself counts as past; one that can't be read doesn't."""
    return f"coalesce({q.date(deadline)} <= DATE '{as_of}', false)"


def listed(q: Spark, x: str) -> str:
    """Parts between commas, semicolons and line breaks, trimmed, empty ones dropped."""
    return q.filter(q.map(q.split(f"coalesce({x}, '')", r"[,;\n]"), "p", "trim(p)"), "p", "p <> ''")


def keywords(q: Spark, *fields: str) -> str:
    """The set of lower-cased words of the fields."""
    t = "lower(concat_ws(' ', " + ", ".join(f"nullif({f}, '')" for f in fields) + "))"
    return q.distinct(q.filter(q.split(t, r"[,\s/()-]+"), "w", "w <> ''"))


def jaccard_distance(q: Spark, a: str, b: str) -> str:
    both, union = q.common(a, b), f"({q.size(a)} + {q.size(b)} - {q.common(a, b)})"
    return f"CASE WHEN {union} = 0 THEN CAST(0 AS double) ELSE 1 - CAST({both} AS double) / {union} END"


def score(q: Spark, x: str) -> str:
    """A score from a reply: missing is 5, fractions are cut, 0 and 10 are the ends."""
    v = q.double(x)
    return f"CAST(greatest(0, least(10, trunc_({v}))) AS int)".replace(f"trunc_({v})", f"CASE WHEN {v} IS NULL THEN 5 ELSE floor(abs({v})) * sign({v}) END")


def codes(q: Spark, x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q.lit(k)} THEN {q.lit(v)}" for k, v in table.items()) + f" ELSE {x} END"


def allowed_gender(q: Spark, profile: str, wanted: str) -> str:
    """Whether an advert that asks for ``wanted`` is open to a profile: a missing demand always is."""
    g = f"lower(trim(coalesce({profile}, '')))"
    inside = lambda x, ws: f"{x} IN (" + ", ".join(q.lit(w) for w in ws) + ")"
    rules = " ".join(f"WHEN {inside(g, names)} THEN {inside(wanted, [*labels, *NEUTRAL])}" for names, labels in GENDERS.values())
    return f"({wanted} IS NULL OR (CASE WHEN {inside(g, ANY_GENDER)} THEN true {rules} ELSE {inside(wanted, NEUTRAL)} END))"




#: Levels of experience as listing pages number them.
EXPERIENCE_LEVELS = {"Không yêu cầu": 1, "Dưới 1 năm": 2, "1 năm": 3, "2 năm": 4, "3 năm": 5, "4 năm": 6, "5 năm": 7, "Trên 5 năm": 8}


def experience_level(q: Spark, x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q.lit(k)} THEN {v}" for k, v in EXPERIENCE_LEVELS.items()) + " END"


def paged_url(base: Column, page: Column) -> Column:
    """The address of a listing's page; the first has none of its own."""
    sign = F.when(base.contains("?"), "&").otherwise("?")
    return F.when(page <= 1, base).otherwise(F.concat(base, sign, F.lit("page="), page.cast("string")))


def filtered_url(base: Column, level: Column, page: Column, family: Column | None = None, newest: bool = False) -> Column:
    """The address of a listing of one level of experience; null without a level."""
    fixed = ("&sort=up_top" if newest else "") + "&type_keyword=1&sba=1&saturday_status=0"
    parts = [base, F.lit("?exp="), level.cast("string"), F.lit(fixed)]
    if family is not None:
        parts.append(F.coalesce(F.concat(F.lit("&category_family="), family), F.lit("")))
    parts.append(F.when(page > 1, F.concat(F.lit("&page="), page.cast("string"))).otherwise(""))
    return F.concat(*parts)
