"""Hand-derived values of the rule-ordered functions."""

import pytest

from hirelode.functions import geo, records, salary
from hirelode.functions.dialect import SPARK, column


def one(spark, sql, **cols):
    kinds = {str: "string", float: "double", int: "bigint", bool: "boolean", type(None): "string", list: "array<string>"}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in cols.items()))
    return df.select(column(sql).alias("r")).collect()[0].r


@pytest.mark.parametrize(
    "text, want",
    [
        ("10 - 20 triệu", (10e6, 20e6, "range")),
        ("20 – 30 triệu", (20e6, 30e6, "range")),
        ("8-10tr", (8e6, 10e6, "range")),
        ("Thỏa thuận", (None, None, "negotiable")),
        ("Upto 25 Triệu", (0, 25e6, "upto")),
        ("Từ 15 triệu", (15e6, None, "from")),
        ("Từ 10 đến 15 triệu", (10e6, None, "from")),
        ("15 triệu", (15e6, 15e6, "fixed")),
        ("50k/giờ", (8e6, 8e6, "hourly")),
        ("300k/ngày", (6.6e6, 6.6e6, "daily")),
        ("300.000/ngày", (6600, 6600, "daily")),
        ("1000 USD", (24e6, 24e6, "usd")),
        ("1,000 - 2,000 USD", (24000, 0, "usd_range")),
        ("1 tỷ", (1e9, 1e9, "fixed")),
        ("10 - 15 triệu tại công ty", (10e9, 15e9, "range")),
        ("Cạnh tranh", (None, None, "unknown")),
        (None, (None, None, "unknown")),
    ],
)
def test_salary(spark, text, want):
    k = salary.kind(SPARK, "x")
    got = tuple(one(spark, sql, x=text) for sql in (salary.bound(SPARK, "x", k, False), salary.bound(SPARK, "x", k, True), k))
    assert got == want


@pytest.mark.parametrize("a, b, want", [("Thỏa thuận", "10 - 20 triệu", 70), ("15 triệu", "Thỏa thuận", 75), ("15 triệu", "", 50), ("15 triệu", "10 - 20 triệu", 100), ("8 triệu", "10 - 20 triệu", 95), ("25 triệu", "10 - 20 triệu", 68), ("100 triệu", "10 - 15 triệu", 20)])
def test_compare(spark, a, b, want):
    ka, kb = salary.kind(SPARK, "a"), salary.kind(SPARK, "b")
    sql = salary.compare(SPARK, ka, *[f"({salary.bound(SPARK, 'a', ka, u)})" for u in (False, True)], kb, *[f"({salary.bound(SPARK, 'b', kb, u)})" for u in (False, True)])
    assert one(spark, sql, a=a, b=b) == want


@pytest.mark.parametrize("text, lo, hi, want", [("40-200tr", 4e6, 200e6, (40e6, 200e6)), ("25 triệu", None, None, (25e6, None)), ("x", 500000.0, None, (5e6, None))])
def test_repair(spark, text, lo, hi, want):
    df = spark.createDataFrame([(text, lo, hi)], "x string, lo double, hi double")
    got = df.select(*[column(salary.repaired(SPARK, salary.stated_millions(SPARK, "x"), "lo", "hi", u)).alias(str(u)) for u in (False, True)]).collect()[0]
    assert tuple(got) == want


@pytest.mark.parametrize("text, code, report", [("", "junior", "junior"), ("Không yêu cầu", "junior", "junior"), ("Dưới 1 năm", "junior", "junior"), ("1 năm", "mid", "junior"), ("3 năm", "mid", "mid"), ("15 năm", "senior", "senior"), ("10 năm", "senior", "senior"), ("11 năm", "mid", "junior"), ("12 năm", "mid", "mid"), ("abc", "junior", "junior")])
def test_tier(spark, text, code, report):
    assert one(spark, records.tier(SPARK, "x"), x=text) == code and one(spark, records.tier(SPARK, "x", "junior"), x=text) == report


def test_fields(spark):
    assert one(spark, records.gender(SPARK, "a", "b", "c"), a="Kế toán - Nữ", b="Nam", c="") == "Nữ"
    assert one(spark, records.gender(SPARK, "a", "b", "c"), a="x", b="Male", c="Nữ từ 22 tuổi") == "Nữ"
    assert [one(spark, records.education(SPARK, "x"), x=t) for t in ("Tốt nghiệp Đại học", "THPT", "Trung cấp nghề", "nan", "Thạc sĩ")] == ["Đại học", "Trung học", "Trung cấp", "", ""]
    assert one(spark, records.canonical_url(SPARK, "x"), x="https://x/y/1.html?a=1#z") == "https://x/y/1.html"
    assert one(spark, records.deadline_in(SPARK, "x"), x="Hạn nộp hồ sơ: 15/05/2026") == "15/05/2026"
    assert one(spark, records.expired(SPARK, "x", "2026-05-15"), x="15/05/2026") is True and one(spark, records.expired(SPARK, "x", "2026-05-14"), x="1/6/2026") is False
    assert [one(spark, records.score(SPARK, "x"), x=t) for t in ("11", "-1", None, "7.9", "nonsense")] == [10, 0, 5, 7, 5]
    assert one(spark, geo.simplified(SPARK, "x"), x="Tầng 5, Tòa nhà ABC, Số 12 Lê Lợi, Quận 1, TP Hồ Chí Minh") == "Lê Lợi, Quận 1, TP Hồ Chí Minh"
    assert one(spark, geo.simplified(SPARK, "x"), x="171 Hai Bà Trưng, Hà Nội") == "Hai Bà Trưng, Hà Nội"
    assert one(spark, geo.city(SPARK, "a", "b"), a="1 Lê Lợi, TP. Hồ Chí Minh", b="") == "Hồ Chí Minh" and one(spark, geo.city(SPARK, "a", "b"), a="", b="Đắk Lắk") == "Đắk Lắk"


@pytest.mark.parametrize("km, want", [(0, 10.0), (10, 7.2), (30, 3.7), (56, 1.5), (100, 1.5)])
def test_distance_score(spark, km, want):
    assert one(spark, geo.distance_score("x", 30, 1.5), x=float(km)) == want


def test_city_in_any_case(spark):
    city = lambda a, b="": one(spark, geo.city(SPARK, "a", "b"), a=a, b=b)
    assert city("12 LÊ LỢI, TP. HỒ CHÍ MINH") == "HỒ CHÍ MINH" and city("khu 3, đà nẵng") == "đà nẵng" and city("x", "thành phố hà nội") == "hà nội"
    assert city("KCN Bình Dương") == "Bình Dương" and city(None, " Huế ") == "Huế"


def test_city_of_company(spark):
    city = lambda a, b=None: one(spark, geo.company_city(SPARK, "a", "b"), a=a, b=b)
    assert city("Tầng 3, TP.HCM", "Hà Nội") == "Hồ Chí Minh" and city("Da Nang, Ha Noi") == "Hà Nội" and city("hà nội", "Huế") == "Huế" and city(None, "Huế") == "Huế"


def test_pay_is_repaired_by_the_title(spark):
    from hirelode import api

    raw = spark.createDataFrame([("u1", "Kế toán 12 - 15 triệu", None, "=== MÔ TẢ CÔNG VIỆC ===\nLàm sổ", None), ("u2", "Kế toán 30tr", None, None, None)], "url string, title string, overview string, job_details string, company_address string")
    parsed = spark.createDataFrame([("u1", "Thỏa thuận", 1.2e6, None), ("u2", "10 triệu", 1e6, 2e6)], "url string, job_salary string, salary_min double, salary_max double")
    got = {r.url: (r.salary_min, r.salary_max, r.job_description) for r in api.clean(raw, parsed).collect()}
    assert got == {"u1": (12e6, 15e6, "Làm sổ"), "u2": (10e6, 10e6, "")}
    assert api.clean(raw).count() == 2


def _page(spark, text, least=50):
    return one(spark, records.blocked_page(SPARK, "x", least), x=text)


def test_blocked_pages(spark):
    body = "x" * 100
    assert _page(spark, body) and _page(spark, None) and _page(spark, f'<div class="job-detail__bodyx">{body}</div>') and _page(spark, f"<p class='job-title'>{body}</p>")
    for tag, name in records.PAGE_MARKERS:
        assert not _page(spark, f"<{tag} id=1 class='a {name} b'>{body}</{tag}>")
    assert _page(spark, '<h1 class="job-title">' + "x" * 4900, 5000) and not _page(spark, '<h1 class="job-title">' + "x" * 5000, 5000)


def test_quality_gate(spark):
    details = "=== MÔ TẢ CÔNG VIỆC ===\n" + "m" * 30 + "\n=== YÊU CẦU ỨNG VIÊN ===\n" + "y" * 10
    gate = lambda **k: one(spark, records.quality_gate(SPARK, 50), **({"title": "t", "overview": "Kinh nghiệm: 2 năm\n" + "o" * 40, "job_details": details} | k))
    assert gate() is True
    for bad in ({"title": " "}, {"overview": "Kinh nghiệm: 2 năm"}, {"overview": "o" * 60}, {"job_details": details.replace("m" * 30, "m" * 29)}, {"job_details": details.replace("y" * 10, "y" * 9)}, {"job_details": None}):
        assert gate(**bad) is False


def test_overview_parts(spark):
    text = "Kinh nghiệm: 2 năm\nYêu cầu:\n Java \n\nSQL\nQuyền lợi:\nLương\nChuyên môn:\nBackend\nWeb\n=== X"
    assert one(spark, records.requirement_tags(SPARK, "x"), x=text) == "Backend, Web" and one(spark, records.specialisations(SPARK, "x"), x=text) == "Java, SQL"
    assert one(spark, records.requirement_tags(SPARK, "x"), x=None) == ""


def test_listing_addresses(spark):
    from pyspark.sql import functions as F

    url = lambda c: spark.range(1).select(c.alias("u")).collect()[0].u
    b, n = F.lit("https://x/viec"), F.lit
    assert url(records.paged_url(b, n(1))) == "https://x/viec" and url(records.paged_url(b, n(3))) == "https://x/viec?page=3" and url(records.paged_url(n("https://x?a=1"), n(2))) == "https://x?a=1&page=2"
    assert url(records.filtered_url(b, n(3), n(2), family=n("r1"))) == "https://x/viec?exp=3&type_keyword=1&sba=1&saturday_status=0&category_family=r1&page=2"
    assert url(records.filtered_url(b, n(8), n(1), newest=True)) == "https://x/viec?exp=8&sort=up_top&type_keyword=1&sba=1&saturday_status=0"
