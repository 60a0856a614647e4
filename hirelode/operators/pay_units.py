"""Pay stated in several currencies, scales and periods, brought to one unit.

Each figure is a number times a money unit times a period.  The columns of an
advert are tied by identities: the amount in the text equals the amount in the
figure columns, and both are a month's pay of the usual size.  Of all
combinations of money unit and period, for the text and for the columns, the one
is taken whose log residuals against these identities, with what the wording
says of the units as a prior, are least; a choice that is not clearly better
than the next is flagged.  All of it is built-in Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import evaluated

#: How the units of the unit table are written.
MONEY = {
    "USD": r"usd|\$|đô|dollar|do la",
    "EUR": r"eur|€",
    "tỷ VND": r"t[ỷỉ]|ty(?![\p{L}])",
    "triệu VND": r"triệu|trieu|tr(?![\p{L}])|củ|m(?![\p{L}])|million",
    "nghìn VND": r"nghìn|nghin|ngàn|ngan|1[.,]000\s*đ|k(?![\p{L}])",
    "VND": r"vnđ|vnd|đồng|dong|đ(?![\p{L}])",
}
PERIOD = {
    "giờ": r"/\s*(?:h|giờ|gio|hour|hr)(?![\p{L}])|(?<![\p{L}\d])(?:một|mot|1|mỗi|moi|theo|per|an|lương)\s*(?:giờ|gio|hour|h)(?![\p{L}])",
    "ngày": r"/\s*(?:ngày|ngay|day|d)(?![\p{L}])|(?<![\p{L}\d])(?:một|mot|1|mỗi|moi|theo|per|a|lương)\s*(?:ngày|ngay|day)(?![\p{L}])|ngày công|ngay cong",
    "năm": r"/\s*(?:năm|nam|year|yr|y)(?![\p{L}])|(?<![\p{L}\d])(?:một|mot|1|mỗi|moi|theo|per|a|lương)\s*(?:năm|nam|year)(?![\p{L}])",
}
_GROUPED = r"(?!0)\d{1,3}(?:[ ., ]\d{3})+(?![\d])"
_UNIT = r"t[ỷỉ]|triệu|trieu|tr(?!\p{L})|củ|m(?!\p{L})|million|nghìn|nghin|ngàn|ngan|k(?!\p{L})"
AMOUNT = rf"({_GROUPED}|\d+(?:[.,]\d+)?)\s*({_UNIT})?(?:(?<=[\p{{L}}])(\d)(?!\d))?\s*(rưỡi|ruoi)?"
#: What a unit costs, in natural logarithms, that the wording doesn't speak of, and one that it speaks against.
UNSAID, AGAINST = 4.0, 9.0
#: The usual size of a month's pay weighs less than another figure of the advert.
USUAL = 0.5
MONTH = "tháng"
LOWEST = r"(?:^|[^\p{L}])(?:từ|tu|trên|tren|tối thiểu|toi thieu|ít nhất|it nhat|from|min|at least|above|over|>=?|≥)(?![\p{L}])|trở lên|tro len|\d\s*\+"
HIGHEST = r"(?:^|[^\p{L}])(?:up\s*to|upto|tới|toi|đến|den|lên đến|len den|lên tới|tối đa|toi da|dưới|duoi|max|under|below|<=?|≤)(?![\p{L}])"


def _named(text: Column, names: dict[str, str]) -> Column:
    """The first unit whose wording is in ``text``, else null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(n)) for n, p in names.items()])


def _number(text: Column, decimal_dot: Column) -> Column:
    """The value of a written number; with ``decimal_dot`` a single dot group is a fraction."""
    grouped = text.rlike(rf"^{_GROUPED}$") & ~decimal_dot
    return F.when(F.coalesce(grouped, F.lit(False)), F.regexp_replace(text, r"[^\d]", "")).otherwise(F.regexp_replace(text, ",", ".")).try_cast("double")


MAX_UNITS = 1000


def _factors(units: DataFrame) -> dict[str, float]:
    """Unit name to factor; more than :data:`MAX_UNITS` units raise ``ValueError``, as all are part of the plan."""
    rows = units.where("unit_name is not null and factor > 0").select("unit_name", "factor").limit(MAX_UNITS + 1).collect()
    if len(rows) > MAX_UNITS:
        raise ValueError("more units than a plan can hold")
    return {r["unit_name"]: float(r["factor"]) for r in rows}


def pay_candidates(jobs: DataFrame, units: DataFrame) -> DataFrame:
    """One row per advert that states an amount: ``job_id, min_vnd, max_vnd, money_unit, period_unit, residual, is_unique, by_residual, basis``.

    ``basis`` is ``text`` where ``job_salary`` holds a figure, else ``columns``.
    Units that the wording names cost nothing, those it names others for
    :data:`AGAINST`; where it names none, a month and any scale of VND cost
    nothing and other units :data:`UNSAID`.  To that come the distance in
    logarithms between text and columns, under the best units of the columns,
    and :data:`USUAL` times that to the typical month's pay of all adverts whose
    unit is named (their median).  ``residual`` is that sum without the prior;
    ``is_unique`` is false where another combination comes within a factor of
    three of the best; ``by_residual`` tells that the wording alone leaves
    several combinations open.  Null, blank and figureless cells give no row;
    figures of zero or less, NaN and infinite ones count as absent.
    """
    f = _factors(units)
    good = lambda c: F.when((c > 0) & (c < 1e15), c)
    d = jobs.select(
        "job_id",
        F.lower(F.coalesce("job_salary", F.lit(""))).alias("t0"),
        F.lower(F.coalesce("salary_note", F.lit(""))).alias("note"),
        good(F.col("salary_min").cast("double")).alias("c1"),
        good(F.col("salary_max").cast("double")).alias("c2"),
    )
    bare = F.col("t0")
    for p in PERIOD.values():
        bare = F.regexp_replace(bare, p, " ")
    d = evaluated(d, {"t": bare, "period_t": _named(F.col("t0"), PERIOD), "period_n": _named(F.col("note"), PERIOD)})
    groups = {k: F.regexp_extract_all("t", F.lit(AMOUNT), F.lit(g)) for k, g in (("n", 1), ("u", 2), ("h", 3), ("r", 4))}
    d = evaluated(d, groups | {"foreign": F.coalesce(*[F.when(F.col("t").rlike(MONEY[m]), F.lit(m)) for m in ("USD", "EUR")])})

    def amount(i: int) -> tuple[Column, Column]:
        at = lambda k: F.get(F.col(k), F.lit(i))
        unit = _named(F.when(at("u") != "", at("u")), {m: MONEY[m] for m in ("tỷ VND", "triệu VND", "nghìn VND")})
        value = _number(at("n"), (F.coalesce(unit, F.lit("")) == "tỷ VND") | (F.col("foreign").isNotNull() & (F.coalesce(unit, F.lit("")) == "nghìn VND")))
        return value + F.coalesce(F.when(at("h") != "", at("h").cast("double") / 10), F.lit(0.0)) + F.when(at("r") != "", 0.5).otherwise(0.0), unit

    (v1, u1), (v2, u2) = amount(0), amount(1)
    d = evaluated(d, {"v1": good(v1), "v2": good(v2), "u1": u1, "u2": u2})
    d = d.withColumn("u", F.coalesce("u2", "u1"))
    both = F.col("v2").isNotNull()
    d = d.withColumns({"a": F.col("v1"), "b": F.when(both, F.col("v2")).otherwise(F.col("v1"))})
    d = d.withColumn("ua", F.when(both, F.coalesce("u1", "u")).otherwise(F.col("u1"))).withColumn("ub", F.col("u"))
    scale = lambda u: F.coalesce(*[F.when(u == m, F.lit(v)) for m, v in (("tỷ VND", 1e9), ("triệu VND", 1e6), ("nghìn VND", 1e3))], F.lit(1.0))
    d = d.withColumns({"a": F.col("a") * scale(F.col("ua")), "b": F.col("b") * scale(F.col("ub"))})
    plain_vnd = F.when(F.col("ub").isNotNull() | F.col("t").rlike(MONEY["VND"]) | F.col("t").rlike(r"\d[ ., ]\d{3}(?!\d)"), F.lit("VND"))
    d = evaluated(d, {"a": F.col("a"), "b": F.col("b"), "money_t": F.coalesce("foreign", plain_vnd), "money_n": _named(F.col("note"), MONEY), "low": F.col("t0").rlike(LOWEST), "high": F.col("t0").rlike(HIGHEST)})
    text, low, high = F.col("a").isNotNull(), F.col("low"), F.col("high")
    d = d.withColumn("basis", F.when(text, "text").when(F.coalesce("c1", "c2").isNotNull(), "columns")).where(F.col("basis").isNotNull())
    d = evaluated(
        d,
        {
            "lo": F.when(text, F.when(~both & high, 0.0).otherwise(F.col("a"))).otherwise(F.coalesce("c1", F.lit(0.0))),
            "hi": F.when(text, F.when(~both & ~high & low, 0.0).otherwise(F.col("b"))).otherwise(F.coalesce("c2", F.lit(0.0))),
            "money_named": F.when(text, F.col("money_t")).otherwise(F.col("money_n")),
        },
    )
    moneys = {m: v for m, v in f.items() if m in MONEY}
    periods = {MONTH: f.get(MONTH, 1.0)} | {p: v for p, v in f.items() if p in PERIOD}
    size = lambda lo, hi: F.log(F.when(lo * hi > 0, F.sqrt(lo * hi)).otherwise(lo + hi))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    d = evaluated(d, {"ts": F.when(text, size(F.col("lo"), F.col("hi"))), "cs": size(zero(F.col("c1")), zero(F.col("c2")))})
    said = lambda unit, own, free: F.when(unit.isNull(), F.lit(0.0 if free else UNSAID)).when(unit == own, 0.0).otherwise(AGAINST)

    def combinations(log_size: Column, money_said: Column, period_said: Column) -> Column:
        """Each money unit and period that the wording allows, with its prior and the figure's logarithm in VND a month."""
        each = [
            F.struct((said(money_said, m, m.endswith("VND")) + said(period_said, p, p == MONTH)).alias("prior"), (log_size + F.log(F.lit(v * w))).alias("v"), F.lit(m).alias("m"), F.lit(p).alias("p"))
            for m, v in moneys.items()
            for p, w in periods.items()
        ]
        return F.filter(F.array(*each), lambda x: x["prior"] < AGAINST)

    d = evaluated(
        d,
        {
            "in_text": F.when(F.col("ts").isNotNull(), combinations(F.col("ts"), F.col("money_t"), F.col("period_t"))),
            "in_columns": F.when(F.col("cs").isNotNull(), combinations(F.col("cs"), F.col("money_n"), F.col("period_n"))),
        },
    )
    d = evaluated(d, {"own": F.coalesce("in_text", "in_columns"), "other": F.when(F.col("in_text").isNotNull(), F.col("in_columns"))})
    sure = F.when(F.size("own") == 1, F.col("own")[0]["v"]).when(F.col("money_named").isNotNull(), F.filter("own", lambda x: x["prior"] == 0)[0]["v"])
    typical = d.agg(F.percentile_approx(sure, 0.5, 10000).alias("typical"))
    d = d.crossJoin(F.broadcast(typical))  # one row: a scalar
    usual = F.coalesce(F.col("typical"), F.log(F.lit(1.5e7)))
    apart = lambda x: F.coalesce(F.array_min(F.transform("other", lambda y: F.abs(x["v"] - y["v"]) + y["prior"])), F.lit(0.0))
    weighed = F.transform("own", lambda x: F.struct((apart(x) + USUAL * F.abs(x["v"] - usual)).alias("res"), x["prior"].alias("prior"), x["m"].alias("m"), x["p"].alias("p")))
    d = evaluated(d, {"weighed": weighed})
    d = evaluated(d, {"ranked": F.array_sort(F.transform("weighed", lambda x: F.struct((x["res"] + x["prior"]).alias("cost"), x["m"].alias("m"), x["p"].alias("p"), x["res"].alias("res"), x["prior"].alias("prior"))))})
    best, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    factor = lambda u, of: F.coalesce(*[F.when(u == n, F.lit(v)) for n, v in of.items()])
    d = evaluated(
        d,
        {
            "money_unit": best["m"],
            "period_unit": best["p"],
            "residual": F.round(best["res"], 6),
            "is_unique": F.coalesce(second["cost"] - best["cost"] >= F.log(F.lit(3.0)), F.lit(True)),
            "by_residual": F.size(F.filter("ranked", lambda x: x["prior"] <= best["prior"])) > 1,
        },
    )
    in_vnd = factor(F.col("money_unit"), moneys) * factor(F.col("period_unit"), periods)
    vnd = lambda c: F.round(F.col(c) * in_vnd).cast("bigint")
    return d.select("job_id", vnd("lo").alias("min_vnd"), vnd("hi").alias("max_vnd"), "money_unit", "period_unit", "residual", "is_unique", "by_residual", "basis")
