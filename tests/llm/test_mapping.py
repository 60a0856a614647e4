import pytest

from hirelode.llm.mapping import LEVELS, PLACES, Vocabulary, map_values, mapped_cells
from hirelode.sources.tables import table

CITIES = [(1, "Hà Nội"), (2, "Hà Nam"), (3, "Hồ Chí Minh"), (4, "Quảng Nam"), (5, "Bà Rịa - Vũng Tàu"), (6, "Long An"), (7, "An Giang"), (8, "Thái Nguyên"), (9, None), (10, "")]


def mapped(spark, values, known=PLACES, entries=CITIES):
    cells = spark.createDataFrame([(v, 1, "t") for v in values], "v string, ref_id int, token string")
    ref = spark.createDataFrame(entries, "ref_id int, city string")
    return {r.v: r.ref_id for r in map_values(cells, "v", ref, "ref_id", "city", known).collect()}




def test_places(spark):
    got = mapped(spark, ["ha noi", "TP. Hà Nội", "Hà ội", "HaNoi", "haf nooij", "H. Nội", "Hc Nam", "KCN X, Quảng Nam", "HCM", "vũng tàu", "lonng an", "ThaiNguyen", "An iGang", "Ha Giang", "Hậu Giang", "Singapore", "Toàn quốc", "zzz"])
    assert got == {"ha noi": 1, "TP. Hà Nội": 1, "Hà ội": 1, "HaNoi": 1, "haf nooij": 1, "H. Nội": 1, "Hc Nam": 2, "KCN X, Quảng Nam": 4, "HCM": 3, "vũng tàu": 5, "lonng an": 6, "ThaiNguyen": 8, "An iGang": 7, "Ha Giang": 0, "Hậu Giang": 0, "Singapore": 0, "Toàn quốc": 0, "zzz": 0}


def test_levels(spark):
    entries = [(1, "Đại học"), (2, "Cao đẳng"), (3, "Trung cấp"), (4, "Trung học"), (5, "Không yêu cầu")]
    got = mapped(spark, ["D.H", "Trugn học", "12/12", "Tốt nghiệp cấp 3", "Bằng cấp: không cần", "Sau đại học", "Thạc sĩ", "Từ cao đẳng", "Chứng chỉ nghề", "Vocational (trung cấp)"], LEVELS, entries)
    assert got == {"D.H": 1, "Trugn học": 4, "12/12": 4, "Tốt nghiệp cấp 3": 4, "Bằng cấp: không cần": 5, "Sau đại học": 0, "Thạc sĩ": 0, "Từ cao đẳng": 2, "Chứng chỉ nghề": 0, "Vocational (trung cấp)": 3}


def test_edges(spark):
    assert mapped(spark, [None, "", " nan ", "Hà Nội", "Hà Nội"]) == {"Hà Nội": 1}
    assert mapped(spark, []) == {} and mapped(spark, ["Hà Nội"], Vocabulary(), []) == {"Hà Nội": 0}
    assert mapped(spark, ["x" * 20000, "từ " * 3000 + "Hà Nội"]) == {"x" * 20000: 0, "từ " * 3000 + "Hà Nội": 1}


def test_whole_table(spark, data):
    jobs, city, edu = (table(spark, data, t) for t in ("jobs", "city_ref", "education_ref"))
    got = mapped_cells(jobs, city, edu)
    assert got.count() == got.select("job_id", "field_name").distinct().count() > 0


def test_names_may_be_a_table(spark):
    cells = spark.createDataFrame([("HCM",), ("Phnom X",), ("Ha Noi",)], "v string")
    ref = spark.createDataFrame(CITIES, "ref_id int, city string")
    names = spark.createDataFrame([("HCM", "Hồ Chí Minh"), ("phnom x", None), (None, "Hà Nội"), ("", None)], "phrase string, entry string")
    assert {r.v: r.ref_id for r in map_values(cells, "v", ref, "ref_id", "city", PLACES, names).collect()} == {"HCM": 3, "Phnom X": 0, "Ha Noi": 1}
    with pytest.raises(ValueError):
        map_values(cells, "v", ref, "ref_id", "city", PLACES, spark.range(100_001).selectExpr("cast(id as string) as phrase", "'x' as entry"))


def test_part_of_an_entry(spark):
    """Both norms: what is missing and what stands beside count against a score."""
    none = Vocabulary(threshold=0.55)
    got = mapped(spark, ["Vũng Tàu", "Bà Rịa", "Vũng", "vũng taau quê"], none)
    assert (got["Vũng Tàu"], got["Bà Rịa"], got["Vũng"]) == (5, 5, 0)


def test_long_tokens_are_looked_up_like_others(spark):
    long = "Llanfairpwllgwyngyllgogerychwyrndrobwll"
    assert mapped(spark, [long[:-2], long[:5] + long[6:], long + "abc", "z" * 30000], Vocabulary(), [(7, long)]) == {long[:-2]: 7, long[:5] + long[6:]: 7, long + "abc": 0, "z" * 30000: 0}


def test_locations_without_any_list_beside_the_entries(spark, data):
    """Against the result with all lists."""
    jobs, city = (table(spark, f"{data}/../sf0.01", t) for t in ("jobs", "city_ref"))
    full = {r.job_location: r.ref_id for r in map_values(jobs, "job_location", city, "ref_id", "city", PLACES).collect()}
    bare = {r.job_location: r.ref_id for r in map_values(jobs, "job_location", city, "ref_id", "city", Vocabulary(threshold=PLACES.threshold)).collect()}
    n = {r.job_location: r["count"] for r in jobs.groupBy("job_location").count().collect()}
    meant = [v for v, r in full.items() if r]
    assert sum(n[v] for v in meant if bare[v] == full[v]) >= 0.95 * sum(n[v] for v in meant)
