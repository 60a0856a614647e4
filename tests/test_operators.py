from pyspark.sql import functions as F

from hirelode import api
from hirelode.config import CONFIG
from hirelode.operators import encoding, expansion, matching, retrieval, scoring, taxonomy


def test_labels_and_descriptions(spark):
    long = "A plan-based business process that is described at length here. More follows."
    rows = [(1, None), (2, ""), (3, "một hai"), (4, "manage staff manage people lead"), (5, "a b c d e f g"), (6, "manage budget. " + long), (7, "x y. z"), (8, "a b c d a")]
    got = {r.k: (r.preferred, r.labels, r.description) for r in taxonomy.split_descriptions(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert got[1] == got[2] == ("", "", "") and got[3] == ("một hai", "", "một hai")
    assert got[4][0] == "manage staff" and got[5][0] == "a b c d" and got[8][0] == "a b c d"
    assert got[6] == ("manage budget.", "manage budget.", long.replace("here. More", "here.. More")) and got[7] == ("x y.", "x y.", "z")


def test_concepts_and_pages(spark):
    reply = '{"title":"T","alternativeLabel":{"en":["a","b"]},"_links":{"hasSkillType":[{"title":"k"}]},"description":{"en":{"literal":"d"}}}'
    df = spark.createDataFrame([(reply,), ('{"alternativeLabel":{"en":"one"}}',), ("no json",), (None,)], "r string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in taxonomy.concept_fields(F.col("r")).items()]).collect()]
    assert got == [("T", "a | b", "k", "d"), ("", "one", "", ""), ("", "", "", ""), ("", "", "", "")]
    page = spark.createDataFrame([('<TITLE>Tin\n <b>A</b></TITLE><h2 class="t">Hai</h2><meta name="description" content="mô tả"><a href="/x">y</a>',), (None,)], "p string")
    one, none = page.select(*[c.alias(n) for n, c in taxonomy.page_fields(F.col("p")).items()]).collect()
    assert (one.page_title, one.heading, one.described, one.n_links) == ("Tin A", "Hai", "mô tả", 1) and (none.page_title, none.n_links) == ("", 0)


def test_crosswalk_and_titles(spark):
    occ = spark.createDataFrame([("o1", "Nurse"), ("o2", "Cook"), (None, None)], "uri string, title string")
    cross = spark.createDataFrame([(1, "nurse ", "c1"), (2, " NURSE", "c2"), (3, "", "c9"), (4, "cook", None)], "row_no int, title string, code string")
    tools = spark.createDataFrame([("c2", "Excel"), ("c2 ", "Excel"), ("c1", "Word"), ("c2", "")], "code string, tool string")
    assert [tuple(r) for r in taxonomy.crosswalk_tools(occ, cross, tools).collect()] == [("o1", "c2", "Excel")]
    nodes = spark.createDataFrame([("t1", "java", "TOOL"), ("s1", "Java (computer programming)", "SKILL"), ("t2", "excel", "TOOL"), ("s2", "Excel", "SKILL"), ("s0", "excel", "SKILL")], "uri string, title string, type string")
    asked = spark.createDataFrame([("Java",), (" EXCEL ",), ("none",), (None,), ("",)], "title string")
    assert {(r.title, r.uri) for r in taxonomy.resolved_titles(asked, nodes).collect()} == {("Java", "s1"), (" EXCEL ", "s0"), ("none", None)}


def test_city_names_aliases_and_streets(spark):
    cities = spark.createDataFrame([(1, "Hà Nội"), (2, "Điện Biên"), (3, "Hồ Chí Minh"), (4, "Bà Rịa - Vũng Tàu")], "ref_id int, city string")
    rows = [("a", "Hanoi"), ("b", "12 Điện Biên Phủ, TP HCM"), ("c", "đường Hà Nội"), ("d", "Vũng Tàu và hn"), ("e", None), ("f", "Hà Nội Plaza"), (None, "Hà Nội"), ("a", "Hanoi")]
    df = spark.createDataFrame(rows, "k string, p string")
    got = {r.k: r.cities for r in matching.city_sets(df, "k", "p", cities, "ref_id", "city").collect()}
    assert got == {"a": [1], "b": [3], "c": [], "d": [1, 4], "e": [], "f": []}
    own = spark.createDataFrame([("Hà Nội", "thu do")], "city string, alias string")
    assert matching.city_sets(spark.createDataFrame([("x", "Thủ đô")], "k string, p string"), "k", "p", cities, "ref_id", "city", own).collect()[0].cities == [1]


def test_nearest_branch(spark):
    kinds = "query string, doc int, point struct<lat:double,lng:double>, branches array<struct<lat:double,lng:double>>, has_address boolean, city_score double"
    here, near, far = (21.0, 105.8), (21.05, 105.8), (10.8, 106.7)
    rows = [("a", 1, here, [far, near, (None, 1.0)], True, 8.5), ("b", 1, None, [near], True, 1.5), ("c", 1, here, [], True, 8.5), ("d", 1, here, [near], False, 8.5), ("e", 1, here, None, None, 1.5), ("f", 1, here, [here], True, 1.5)]
    got = {r.query: (r.km, r.score) for r in matching.nearest_branch(spark.createDataFrame(rows, kinds)).collect()}
    assert 5 < got["a"][0] < 6 and got["a"][1] == 8.3 and got["b"] == (None, 1.5) and got["c"] == (None, 8.5) and got["d"] == (None, 5.0) and got["e"] == (None, 5.0) and got["f"] == (0.0, 10.0)


def test_scored_batches(spark):
    rows = [("a", i, i, "A", f"j{i}") for i in range(1, 41)] + [("b", 1, 1, "B", "j"), ("c", 1, 1, "C", "j"), ("c", 2, 2, "C", "j")]
    pairs = spark.createDataFrame(rows, "query string, doc int, place int, profile string, job string")

    def model(profile, jobs):
        if profile == "B":
            raise RuntimeError
        if profile == "C":
            return [{"relevance": "8", "skills": None, "experience": 99, "education": "x"}]
        return [{k: 7 for k in scoring.DIMENSIONS} if j != "j3" else None for j in jobs]

    got = {(r.query, r.place): r for r in scoring.scored_pairs(pairs, model, parts=4).collect()}
    assert len([k for k in got if k[0] == "a"]) == CONFIG.scored and got["a", 3].is_fallback and not got["a", 4].is_fallback
    assert got["b", 1].is_fallback and got["b", 1].fallback_score == 5.0 and got["a", 3].fallback_score == 4.76
    c = got["c", 1]
    assert (c.relevance, c.skills, c.experience, c.education, c.salary) == (8, 5, 10, 5, 5)
    assert scoring.scored_pairs(pairs.limit(0), model).count() == 0


def test_location_override_and_short_lists(spark):
    kinds = "query string, relevance int, skills int, experience int, education int, salary int, w map<string,double>"
    df = spark.createDataFrame([("a", 8, 8, 7, 9, 7, None), ("b", 8, 8, 7, 9, 7, {"skills": 1.0})], kinds)
    got = {r.query: r.total for r in scoring.with_location(df, F.lit(8.5), F.col("w")).collect()}
    assert got == {"a": 7.9, "b": 8.0}
    jobs = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "query string, doc int, place int")
    assert {(r.doc, r.score) for r in scoring.attached(jobs, spark.createDataFrame([("a", 1, 9.0)], "query string, place int, score double")).collect()} == {(1, 9.0), (2, 5.0)}


def test_parsed_profiles(spark):
    parser = scoring.heading_parser({"kỹ năng": "technical_skills", "học vấn": "education"})
    good = "## Kỹ năng\nJava, SQL\n## Khác\nx\n## Học vấn\nĐại học " + "y" * 40
    df = spark.createDataFrame([(1, good), (2, "ngắn"), (3, None), (4, "không có mục nào " * 100), (5, "z" * 9000 + "\n## Kỹ năng\nA")], "id int, t string")
    got = {r.id: r for r in api.parse_cv(df, "id", "t", [lambda t: 1 / 0, parser]).collect()}
    assert got[1].success and got[1].technical_skills == "Java, SQL" and got[1].education.startswith("Đại học")
    assert got[2].error == got[3].error == "short" and got[4].error == "unparsed" and len(got[4].raw_text) == 1000 and len(got[5].raw_text) == 8000 and got[5].technical_skills == "A"


def test_encoder(spark):
    enc = encoding.HashingEncoder(64)
    v = enc.encode(["kế toán tổng hợp", "Kế toán  tổng hợp viên", "lái xe tải", "", " "])
    assert abs((v[0] ** 2).sum() - 1) < 1e-5 and not v[3].any() and not v[4].any() and v[0] @ v[1] > v[0] @ v[2]
    df = spark.createDataFrame([(1, "kế toán"), (2, None), (None, "x")], "id bigint, t string")
    rows = {r.id: r.vec for r in encoding.encoded(df, "id", "t", enc).collect()}
    assert set(rows) == {1, 2} and not any(rows[2]) and encoding.has_vectors(df, "t") and not encoding.has_vectors(df, "vec") and not encoding.has_vectors(df.limit(0), "t")


def test_allowed_tags(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)], i % 3) for i in range(9)], "id bigint, vec array<double>, tag int")
    q = spark.createDataFrame([(100, [1.0, 1.0], [1]), (101, [1.0, 1.0], None), (102, [1.0, 1.0], [])], "id bigint, vec array<double>, tag array<int>")
    got = {}
    for r in retrieval.nearest(q, v, 20, allow=True).collect():
        got.setdefault(r.query, set()).add(r.doc % 3)
    assert got == {100: {1}, 101: {0, 1, 2}}


def test_expand_near_has_a_cap(spark):
    near = spark.createDataFrame([(1, i, 0.99, i) for i in range(2, 40)] + [(1, 50, 0.5, 50)], "query int, doc int, score double, rank int")
    labels = spark.createDataFrame([(i, [f"a{i}", "same", "third"]) for i in range(2, 60)], "doc int, alts array<string>")
    got = [r.term for r in expansion.expand_near(near, labels, 0.6, 30).orderBy("place").collect()]
    assert len(got) == 30 and got[:4] == ["v1", "a2", "same", "a3"] and "third" not in got and "a50" not in got


def test_pages(spark):
    assert api.page_bounds(0, 500) == (0, 100) and api.page_bounds(3, 0) == (40, 20) and api.page_bounds(None, None) == (0, 20) and api.page_bounds(2, -4) == (1, 1)
    jobs = spark.createDataFrame([(i, f"kế toán {i}" if i % 2 else "lái xe", f"2026-01-{i:02d} 00:00:00") for i in range(1, 31)], "job_id bigint, title string, crawled_date string")
    assert [r.job_id for r in api.browse(jobs, None, 2, 10).collect()] == list(range(20, 10, -1))
    assert {r.job_id % 2 for r in api.browse(jobs, "kế toán", 1, 10).collect()} == {1} and len(api.browse(jobs, "kế toán", 2, 10).collect()) == 5


def test_index_documents(spark):
    kinds = "url string, title string, job_salary string, salary_min double, salary_max double, crawled_date string, content_hash string, company_address string, latitude double, longitude double, is_expired string, extra int"
    rows = [
        ("u1?a", "cũ", "10 triệu", None, None, "2026-01-01", "h0", "12 Lê Lợi", None, None, "no", 1),
        ("u1", " mới ", "10 - 20 triệu", 12e6, float("nan"), "2026-01-02", "h1", "12 Lê Lợi", None, None, "Yes", 1),
        ("u2", "nan", None, None, None, "x", None, "Q1", 1.0, 2.0, None, 1),
    ]
    points = spark.createDataFrame([("12 Lê Lợi", 10.0, 106.0), ("Q1", 9.0, 9.0)], "company_address string, lat double, lng double")
    got = {r.url: r for r in api.build_jobs(spark.createDataFrame(rows, kinds), points).collect()}
    assert set(got) == {"u1", "u2"} and (got["u1"].title, got["u1"].salary_min, got["u1"].salary_max, got["u1"].salary_type, got["u1"].is_expired) == ("mới", 12.0, 20.0, "range", True)
    assert got["u1"].geo_coordinates[0].lat == 10.0 and got["u2"].geo_coordinates[0].lat == 1.0 and got["u2"].title == "" and got["u2"].salary_type == "unknown" and got["u1"].working_time == ""
