"""Scores of retrieved pairs, location order, and the ranked list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import CONFIG, MatchConfig
from ..functions import geo, salary
from ..functions.columns import folded
from ..functions.dialect import Spark


def _words(c: Column) -> Column:
    return F.filter(F.split(folded(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")


#: Other names of cities, folded.
CITY_ALIASES = {
    "Hà Nội": ["hanoi", "hn"], "Hải Phòng": ["haiphong", "hp"], "Quảng Ninh": ["ha long", "halong"], "Lào Cai": ["sapa"], "Phú Thọ": ["viet tri"], "Hà Nam": ["phu ly"],
    "Đà Nẵng": ["danang", "dn"], "Thừa Thiên Huế": ["hue"], "Quảng Nam": ["hoi an"], "Bình Định": ["quy nhon"], "Phú Yên": ["tuy hoa"], "Khánh Hòa": ["nha trang"],
    "Ninh Thuận": ["phan rang"], "Bình Thuận": ["phan thiet"], "Kon Tum": ["kontum"], "Gia Lai": ["pleiku"], "Đắk Lắk": ["buon ma thuot"], "Đắk Nông": ["gia nghia"],
    "Quảng Bình": ["dong hoi"], "Quảng Trị": ["dong ha"], "Nghệ An": ["vinh"], "Hồ Chí Minh": ["hcm", "sai gon", "saigon", "tp hcm"], "Bình Dương": ["thu dau mot"],
    "Đồng Nai": ["bien hoa"], "Bà Rịa - Vũng Tàu": ["vung tau", "ba ria"], "Cần Thơ": ["cantho"], "Long An": ["tan an"], "Tiền Giang": ["my tho"], "Đồng Tháp": ["cao lanh"],
    "An Giang": ["long xuyen", "chau doc"], "Kiên Giang": ["rach gia", "phu quoc"], "Hậu Giang": ["vi thanh"], "Bình Phước": ["dong xoai"],
}
#: Words before or after a city's name that make it a street, ward or building.
STREET_BEFORE = ["phuong", "quan", "duong", "pho", "thon", "ap", "xa", "huyen", "thi tran", "khu pho", "to", "ngo", "hem"]
STREET_AFTER = ["phu", "plaza", "tower", "building", "center", "centre", "street", "road", "avenue"]
MAX_NAMES = 100_000


def alias_table(spark: SparkSession) -> DataFrame:
    """``city, alias``: the usual other names."""
    return spark.createDataFrame([(c, a) for c, names in CITY_ALIASES.items() for a in names], "city string, alias string")


def city_sets(df: DataFrame, key: str, place: str, cities: DataFrame, city_id: str, city: str, aliases: DataFrame | None = None) -> DataFrame:
    """``key, cities``: the sorted ids of the cities whose names stand in ``place``, accents and case aside; empty if none.

    A name counts by its first occurrence, and not if that is part of a street,
    ward or building by one of :data:`STREET_BEFORE` or :data:`STREET_AFTER`
    within 20 letters; ``aliases`` (``city, alias``) are other names, the usual
    ones by default.  Runs of one to four words meet the names in an equi-join
    instead of a scan of all names per row; more than :data:`MAX_NAMES` names
    raise ``ValueError``.  Rows without a key are left out.
    """
    aliases = alias_table(df.sparkSession) if aliases is None else aliases
    name = lambda c: F.array_join(_words(F.col(c)), " ")
    own = cities.select(F.col(city_id).alias("city_id"), F.col(city).alias("c"))
    names = own.select("city_id", name("c").alias("name")).unionByName(own.join(aliases.select(F.col("city").alias("c"), "alias"), "c").select("city_id", name("alias").alias("name")))
    names = names.where("name <> ''").distinct()
    if names.limit(MAX_NAMES + 1).count() > MAX_NAMES:
        raise ValueError("more names of cities than are sent to every task")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), _words(F.col(place)).alias("w"))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(F.array_join(F.slice("w", i, n), " ").alias("name"), i.alias("i"), n.alias("n")))
    none = F.array().cast("array<struct<name:string,i:int,n:int>>")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.when(F.size("w") >= n, at(n)).otherwise(none)))
    met = rows.select("k", "w", F.inline(runs)).join(F.broadcast(names), "name")
    first = F.array_position(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " ")), F.col("name"))
    met = met.where(F.col("i") == first)
    before = F.trim(F.right(F.array_join(F.slice("w", F.lit(1), F.col("i") - 1), " "), F.lit(20)))
    after = F.substring(F.array_join(F.slice("w", F.col("i") + F.col("n"), F.size("w")), " "), 1, 20)
    is_street = reduce(lambda a, b: a | b, [before.endswith(x) for x in STREET_BEFORE] + [after.startswith(x) for x in STREET_AFTER])
    hits = met.where(~is_street).groupBy("k").agg(F.sort_array(F.collect_set("city_id")).alias("cities"))
    every = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
    return every.join(hits, "k", "left").select(F.col("k").alias(key), F.coalesce("cities", F.array().cast("array<int>")).alias("cities"))


def nearest_branch(pairs: DataFrame, cfg: MatchConfig = CONFIG) -> DataFrame:
    """``query, doc, km, score``: the nearest of an advert's branches to the profile, by distance.

    ``pairs``: ``query, doc, point`` (a struct ``lat, lng``), ``branches`` (an
    array of such), ``has_address``, ``city_score``.  Without an address the
    score is 5; without a point on either side it is that of the cities.  Points
    with a null count as missing.
    """
    known = F.filter(F.coalesce("branches", F.array().cast("array<struct<lat:double,lng:double>>")), lambda b: b["lat"].isNotNull() & b["lng"].isNotNull())
    at = F.when(F.col("point.lat").isNotNull() & F.col("point.lng").isNotNull(), F.col("point"))
    rad = lambda x: F.radians(x)

    def km(b: Column) -> Column:
        a = F.pow(F.sin((rad(b["lat"]) - rad(at["lat"])) / 2), 2) + F.cos(rad(at["lat"])) * F.cos(rad(b["lat"])) * F.pow(F.sin((rad(b["lng"]) - rad(at["lng"])) / 2), 2)
        return 2 * geo.EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))

    d = pairs.withColumn("_km", F.when(F.col("has_address") & at.isNotNull(), F.array_min(F.transform(known, km))))
    near = F.round(F.greatest(F.lit(cfg.location_floor), 10 * F.exp(-F.col("_km") / cfg.distance_km)), 1)
    score = F.when(~F.coalesce("has_address", F.lit(False)), F.lit(cfg.unknown_city)).when(F.col("_km").isNotNull(), near).otherwise(F.col("city_score"))
    return d.select("query", "doc", F.round("_km", 3).alias("km"), score.alias("score"))


YEARS = {"no_requirement": 0, "under_1": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "over_5": 6, "all": 0}
RANKS = {"trung_hoc": 1, "trung_cap": 2, "cao_dang": 3, "dai_hoc": 4}
LEVEL_RANKS = {"Trung học": 1, "Trung cấp": 2, "Cao đẳng": 3, "Đại học": 4}


def _case(q: Spark, x: str, table: dict) -> str:
    return f"(CASE {x} " + " ".join(f"WHEN {q.lit(k)} THEN {v}" for k, v in table.items()) + " END)"


def rubric(q: Spark, cv: dict[str, str], job: dict[str, str]) -> dict[str, str]:
    """Six scores from 0 to 10 of a pair, from its columns, as a stand-in for a model that reads both.

    ``cv``: skills and wanted (arrays), experience, education (codes), salary
    (million), cities; ``job``: skills (array), category, experience, education
    (level), pay_kind, pay_min, pay_max (VND), cities.
    """
    share = f"(CAST({q.common(cv['skills'], job['skills'])} AS double) / {q.size(job['skills'])})"
    years, asked = _case(q, cv["experience"], YEARS), q.double(f"nullif({q.ext('coalesce(' + job['experience'] + ', ' + q.lit('') + ')', '([0-9]+)')}, '')")
    have, level = _case(q, cv["education"], RANKS), _case(q, job["education"], LEVEL_RANKS)
    wish = f"({cv['salary']} * 1000000)"
    pay = salary.compare(q, "'fixed'", wish, wish, job["pay_kind"], job["pay_min"], job["pay_max"])
    wanted = cv["wanted"]
    within = f"array_contains({wanted}, {job['category']})" if type(q) is Spark else f"list_contains({wanted}, {job['category']})"
    return {
        "relevance": f"CASE WHEN {wanted} IS NULL OR {q.size(wanted)} = 0 OR {job['category']} IS NULL THEN 5 WHEN {within} THEN 8 ELSE 3 END",
        "skills": f"CASE WHEN {q.size(job['skills'])} = 0 THEN 5 WHEN {share} < 0.2 THEN 1 WHEN {share} < 0.4 THEN 3 WHEN {share} < 0.6 THEN 5 WHEN {share} <= 0.8 THEN 7 ELSE 9 END",
        "experience": f"CASE WHEN {asked} IS NULL THEN 7 WHEN {years} IS NULL THEN 5 WHEN {years} - {asked} > 4 THEN 5 WHEN {years} >= {asked} THEN 9 WHEN {years} = {asked} - 1 THEN 6 ELSE 3 END",
        "education": f"CASE WHEN {level} IS NULL THEN 7 WHEN {have} IS NULL THEN 5 WHEN {have} >= {level} THEN 9 WHEN {have} = {level} - 1 THEN 5 ELSE 2 END",
        "salary": f"CASE WHEN {cv['salary']} IS NULL THEN 7 ELSE CAST(round(({pay}) / 10, 0) AS int) END",
        "location": geo.city_score(q, cv["cities"], job["cities"], CONFIG.same_city, CONFIG.other_city, CONFIG.unknown_city),
    }


def weighted(scores: dict[str, str], cfg: MatchConfig = CONFIG) -> str:
    return "round(" + " + ".join(f"CAST({scores[k]} AS double) * CAST({w} AS double)" for k, w in cfg.weights.items()) + ", 2)"


def fallback(rank0: str, cfg: MatchConfig = CONFIG) -> str:
    """The score of a place in the list when nothing scored it; places count from 0."""
    return f"round(greatest(CAST({cfg.tail_score} AS double), {cfg.fallback_start} - {cfg.fallback_step} * {rank0}), 4)"


def same_city_first(hits: DataFrame, cv_cities: DataFrame, job_cities: DataFrame) -> DataFrame:
    """``hits`` (``query, doc, rank``) with ``same_city`` and ``place``: those of the profile's city first, the order kept within."""
    d = hits.join(cv_cities.select(F.col("query"), F.col("cities").alias("_a")), "query", "left").join(job_cities.select(F.col("doc"), F.col("cities").alias("_b")), "doc", "left")
    d = d.withColumn("same_city", F.coalesce(F.arrays_overlap("_a", "_b"), F.lit(False)))
    w = W.partitionBy("query").orderBy(F.desc("same_city"), "rank")
    return d.withColumn("place", F.row_number().over(w)).drop("_a", "_b")


def ranked(pairs: DataFrame, total: str, cfg: MatchConfig = CONFIG) -> DataFrame:
    """``query, doc, place, match_score, position``: the first ``cfg.scored`` places by their score, the others by the tail's, ties by place."""
    score = F.when(F.col("place") <= cfg.scored, F.col(total)).otherwise(F.lit(cfg.tail_score))
    w = W.partitionBy("query").orderBy(F.desc("match_score"), "place")
    return pairs.withColumn("match_score", score).withColumn("position", F.row_number().over(w)).select("query", "doc", "place", "match_score", "position")


