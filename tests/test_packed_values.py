import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hirelode.operators.packed_values import fields_as_rows, split_packed

SCHEMA = "job_id bigint, technical_skills string, languages string, cell string, _c string, pos_no int"


def split(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = split_packed(fields_as_rows(df, "job_id", ["technical_skills", "languages"]), "cell", "field_name", ["languages"], ["languages"])
    return sorted((r.job_id, r.field_name[:4], r.pos_no, r.value_text) for r in out.collect())


def values(spark, tech=None, lang=None):
    return [v for *_, v in split(spark, [(1, tech, lang, "x", "y", 9)])]


def test_notations(spark):
    assert values(spark, 'Java; "Hạch toán, lập báo cáo"|C/C++') == ["Java", "Hạch toán, lập báo cáo", "C/C++"]
    assert values(spark, '["Word", "Giải \\"Bút\\" A"]') == ["Word", 'Giải "Bút" A']
    assert values(spark, "['a', 'b, c']") == ["a", "b, c"]
    assert values(spark, '"Chứng ""X"""|PMP') == ['Chứng "X"', "PMP"]
    assert values(spark, "• A\n- B\n2) C\n+ 3-lớp") == ["A", "B", "C", "3-lớp"]
    assert values(spark, "IELTS 6,5,HTML5,3ds Max") == ["IELTS 6,5", "HTML5", "3ds Max"]
    assert values(spark, "Tin (Word, Excel), A - B / C") == ["Tin (Word, Excel)", "A", "B", "C"]
    assert values(spark, None, "Tiếng Anh (nghe, nói) và Hàn/Nhật & Lào") == ["Tiếng Anh (nghe, nói)", "Hàn", "Nhật", "Lào"]


def test_blank_and_odd_cells(spark):
    assert split(spark, [(1, None, "", "", "", 0), (2, " nan ", " ", "", "", 0), (None, "a,,a", None, None, None, None)]) == [(None, "tech", 1, "a"), (None, "tech", 2, "a")]
    assert values(spark, '"unclosed, b') == ['"unclosed', "b"]
    assert values(spark, "(a, b; c") == ["(a", "b", "c"]
    assert values(spark, "0, b") == ["0", "b"]  # the marks themselves
    assert values(spark, "[]") == [] and values(spark, ",;|") == []
    assert split(spark, []) == []


def test_very_long_cell(spark):
    assert len(values(spark, ", ".join(f'"v {i}, x"' for i in range(5000)))) == 5000
    assert values(spark, '"' * 9999) is not None


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from('ab,;|"(\n '), min_size=1, max_size=8), min_size=1, max_size=6))
def test_quoted_round_trip(spark, items):
    cell = ",".join('"' + x.replace('"', '""') + '"' for x in items)
    assert values(spark, cell) == [re.sub(r"^\s+|\s+$", "", x) for x in items if x.strip()] or cell.strip().lower() == "nan"
