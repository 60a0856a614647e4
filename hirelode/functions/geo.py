"""Places: simplified addresses, cities, distances."""

from __future__ import annotations

from .dialect import Spark

#: Cities looked for by name in an address, the larger ones first.
MAJOR = "Hồ Chí Minh|Hà Nội|Đà Nẵng|Hải Phòng|Cần Thơ"
MINOR = "Bình Dương|Đồng Nai|Bắc Ninh|Hưng Yên|Vĩnh Phúc|Quảng Ninh"
EARTH_KM = 6371.0088


#: Parts of an address that are dropped, in this order.
ADDRESS_NOISE = (
    r"(?i)^(Tầng|tầng|TẦNG|Lầu|lầu|LẦU|Phòng|phòng|PHÒNG|P\.)\s*\d+[A-Za-z]?\s*,?\s*",
    r"(?i)(Tòa nhà|tòa nhà|TÒA NHÀ|Building|Tower|Centre|Center)\s+[^,]+,?\s*",
    r"(Số|số|SỐ)\s+[\d/]+[A-Za-z]?\s*,?\s*",
    r"^\d+[\-/]?\d*[A-Za-z]?\s*,?\s*",
    r"(Ngõ|ngõ|NGÕ|Ngách|ngách|NGÁCH|Hẻm|hẻm|HẺM|Lô|lô|LÔ|Khu|khu|KHU)\s+\d+[A-Za-z]?\s*,?\s*",
)
#: How a company's address names a city, and the city; the first that stands in it counts.
COMPANY_CITIES = [
    ("Hà Nội", "Hà Nội"), ("Ha Noi", "Hà Nội"), ("Hồ Chí Minh", "Hồ Chí Minh"), ("Ho Chi Minh", "Hồ Chí Minh"), ("TP HCM", "Hồ Chí Minh"), ("TP.HCM", "Hồ Chí Minh"), ("HCM", "Hồ Chí Minh"),
    ("Đà Nẵng", "Đà Nẵng"), ("Da Nang", "Đà Nẵng"), ("Hải Phòng", "Hải Phòng"), ("Hai Phong", "Hải Phòng"), ("Bình Dương", "Bình Dương"), ("Binh Duong", "Bình Dương"),
    ("Đồng Nai", "Đồng Nai"), ("Dong Nai", "Đồng Nai"), ("Cần Thơ", "Cần Thơ"), ("Can Tho", "Cần Thơ"),
]


def company_city(q: Spark, address: str, location: str) -> str:
    """The city a company's address names, else the stated location; case counts, ``nan`` is no address."""
    rules = " ".join(f"WHEN contains(coalesce({address}, ''), {q.lit(a)}) THEN {q.lit(c)}" for a, c in COMPANY_CITIES)
    return f"CASE {rules} ELSE {location} END"


def simplified(q: Spark, x: str) -> str:
    """An address without floor, building, house number and alley."""
    s = f"coalesce({x}, '')"
    for p in ADDRESS_NOISE:
        s = q.repl(s, p)
    s = q.repl(q.repl(s, r"\s*,\s*,", ","), r"^\s*,\s*")
    return q.repl(q.repl(s, r"^\s+|\s+$"), r"^[,\s]+|[,\s]+$")


def city(q: Spark, address: str, location: str) -> str:
    """The city named in the address, else in the location, in any case and as it is written there; else the location itself."""
    found = []
    for x in (address, location):
        t = f"coalesce({x}, '')"
        found += [f"nullif({q.ext(t, p)}, '')" for p in (rf"{q.any_case}(?:Thành phố|TP\.?|Tp\.?)\s+({MAJOR})", f"{q.any_case}({MAJOR})", f"{q.any_case}({MINOR})")]
    return f"coalesce({', '.join(found)}, trim(coalesce({location}, '')))"


def first_branch(q: Spark, x: str) -> str:
    return f"trim({q.at(q.split(f'coalesce({x}, {q.lit(str())})', r' \| '), 0)})"


def distance_km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """The great-circle distance (within 0.6 % of the ellipsoid's)."""
    h = f"power(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians(({lng2}) - ({lng1})) / 2), 2)"
    return f"(2 * {EARTH_KM} * asin(sqrt(least(CAST(1 AS double), {h}))))"


def distance_score(km: str, scale: float, floor: float) -> str:
    return f"round(greatest(CAST({floor} AS double), 10 * exp(-({km}) / {scale})), 1)"


def city_score(q: Spark, a: str, b: str, same: float, other: float, unknown: float) -> str:
    """By two arrays of cities."""
    return f"CASE WHEN {q.size(a)} > 0 AND {q.size(b)} > 0 THEN (CASE WHEN {q.overlap(a, b)} THEN CAST({same} AS double) ELSE CAST({other} AS double) END) ELSE CAST({unknown} AS double) END"
