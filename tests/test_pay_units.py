import pytest

from hirelode.operators.pay_units import pay_candidates

JOB = "job_id bigint, job_salary string, salary_min double, salary_max double, salary_note string, t string, u1 string"
UNITS = [("VND", "money", 1.0), ("nghìn VND", "money", 1e3), ("triệu VND", "money", 1e6), ("tỷ VND", "money", 1e9), ("USD", "money", 24000.0), ("EUR", "money", 26000.0), ("tháng", "period", 1.0), ("năm", "period", 1 / 12), ("ngày", "period", 22.0), ("giờ", "period", 160.0)]


def run(spark, rows):
    jobs = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], JOB)
    units = spark.createDataFrame(UNITS, "unit_name string, unit_kind string, factor double")
    return {r.job_id: (r.min_vnd, r.max_vnd) for r in pay_candidates(jobs, units).collect()}


@pytest.mark.parametrize(
    "text, want",
    [
        ("10 - 20 triệu", (10e6, 20e6)),
        ("6tr-25tr", (6e6, 25e6)),
        ("0.95k – 1.15k USD", (22.8e6, 27.6e6)),
        ("10.000-11.000 nghìn", (10e6, 11e6)),
        ("Up to 0,324 tỷ/năm", (0, 27e6)),
        ("29tr5", (29.5e6, 29.5e6)),
        ("17 triệu rưỡi trở lên", (17.5e6, 0)),
        ("530k 1 ngày", (11.66e6, 11.66e6)),
        ("58.000-85.000 đ/h", (9.28e6, 13.6e6)),
        ("21 000 000-25 000 000 VND", (21e6, 25e6)),
        ("Tối thiểu $1,200", (28.8e6, 0)),
        ("1.400 đô", (33.6e6, 33.6e6)),
        ("156 triệu/năm", (13e6, 13e6)),
    ],
)
def test_texts(spark, text, want):
    assert run(spark, [(text, None, None, None)]) == {0: want}


def test_columns_and_scale(spark):
    got = run(spark, [("10 triệu", None, None, None)] * 3 + [("Thỏa thuận", 26.0, 44.0, "GROSS"), (None, 12500.0, None, "ĐVT 1.000đ"), ("", None, 550.0, "ngày công, ĐVT 1.000đ"), ("Cạnh tranh", 22e6, 22e6, None)])
    assert (got[3], got[4], got[5], got[6]) == ((26e6, 44e6), (12.5e6, 0), (0, 12.1e6), (22e6, 22e6))


def test_nothing_stated_and_empty(spark):
    assert run(spark, [(None, None, None, None), ("", float("nan"), 0.0, None), ("Negotiable", None, -5.0, "NET")]) == {}
    assert run(spark, []) == {}
    assert run(spark, [("1" * 5000, None, None, None)]) == {}


def units_of(spark, rows):
    jobs = spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], JOB)
    units = spark.createDataFrame(UNITS, "unit_name string, unit_kind string, factor double")
    return {r.job_id: r for r in pay_candidates(jobs, units).collect()}


def test_the_columns_tell_the_unit_of_the_text(spark):
    """Text and columns are one amount: the combination that makes them equal is taken, whatever is usual."""
    usual = [("15 triệu", 15e6, 15e6, None)] * 5
    got = units_of(spark, [*usual, ("950", None, 950e6, "VND"), ("950", None, 950e3, "VND"), ("12", 12.0, None, "ĐVT 1.000đ/h"), ("396 triệu/năm", None, 3.3e6, None)])
    assert (got[5].money_unit, got[5].max_vnd, got[5].by_residual) == ("triệu VND", 950_000_000, True)
    assert (got[6].money_unit, got[6].max_vnd) == ("nghìn VND", 950_000)
    assert (got[8].max_vnd, got[8].period_unit, got[8].by_residual) == (33_000_000, "năm", False) and got[8].residual > 2  # the wording outweighs a slip of the columns
    assert got[0].residual == 0.0 and got[0].is_unique and not got[0].by_residual


def test_two_scales_as_likely_are_flagged(spark):
    got = units_of(spark, [("15 triệu", None, None, None)] * 5 + [(None, 475.0, 475.0, None), (None, 15.0, None, None)])
    assert not got[5].is_unique and got[5].by_residual and got[6].is_unique and got[6].money_unit == "triệu VND"


def test_too_many_units(spark):
    units = spark.createDataFrame([(f"u{i}", 1.0) for i in range(1001)], "unit_name string, factor double")
    with pytest.raises(ValueError):
        pay_candidates(spark.createDataFrame([], JOB), units)
