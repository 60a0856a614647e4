"""Pay texts: the rule-ordered reading, comparison and repair of magnitudes.

Keywords count as substrings and a dot is always a decimal point; the exact
reading of units is ``operators.pay_units``.
"""

from __future__ import annotations

from .dialect import Spark, has_any

#: Patterns of figures, and what an hour, a day and a dollar are worth.
NUMBER = r"(\d+(?:\.\d+)?)"
SPAN = r"(\d+(?:\.\d+)?)\s*[-–—]\s*(\d+(?:\.\d+)?)"
HOURS, DAYS, USD = 160, 22, 24000
#: Keywords by meaning.
NEGOTIABLE = ["thoa thuan", "thoả thuận", "thỏa thuận", "trao doi", "trao đổi", "deal", "negotiate", "competitive"]
HOURLY, DAILY = ["gio", "giờ", "/h", "hour"], ["ngay", "ngày", "/day", "daily"]
UPTO = ["upto", "len den", "lên đến", "toi da", "tối đa", "max"]
FROM = ["tu", "từ", "from", "tren", "trên", "above", "over"]
UNITS = [(1e9, ["ty", "tỷ", "billion"]), (1e6, ["tr", "trieu", "triệu", "million"]), (1e3, ["k", "nghin", "nghìn", "thousand"])]


def _unit(q: Spark, t: str) -> str:
    return "CASE " + " ".join(f"WHEN {has_any(q, t, w)} THEN CAST({int(f)} AS double)" for f, w in UNITS) + " ELSE CAST(1 AS double) END"


def kind(q: Spark, x: str) -> str:
    """``unknown, negotiable, hourly, daily, usd, usd_range, range, upto, from`` or ``fixed``; the first rule that holds counts."""
    t = f"lower(trim({x}))"
    has_number = q.match(t, NUMBER)
    two = f"{q.size(q.extall(t, NUMBER))} >= 2 AND {has_any(q, t, ['-', '–', '—'])}"
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN 'unknown' WHEN {has_any(q, t, NEGOTIABLE)} THEN 'negotiable' "
        f"WHEN {has_any(q, t, HOURLY)} THEN 'hourly' WHEN {has_any(q, t, DAILY)} THEN 'daily' "
        f"WHEN {has_any(q, t, ['$', 'usd'])} THEN (CASE WHEN {two} THEN 'usd_range' ELSE 'usd' END) "
        f"WHEN {q.match(t, SPAN)} THEN 'range' WHEN NOT {has_number} THEN 'unknown' "
        f"WHEN {has_any(q, t, UPTO)} THEN 'upto' WHEN {has_any(q, t, FROM)} THEN 'from' ELSE 'fixed' END"
    )


def bound(q: Spark, x: str, kind_sql: str, upper: bool) -> str:
    """The lower or upper amount in VND a month of a text of the given kind."""
    t = f"lower(trim({x}))"
    first = q.double(f"nullif({q.ext(t, NUMBER)}, '')")
    numbers = q.extall(t, NUMBER)
    span = q.double(f"nullif({q.ext(t, SPAN, 2 if upper else 1)}, '')")
    other = q.double(q.at(numbers, 1 if upper else 0))
    unit = _unit(q, t)
    fixed = f"{first} * ({unit})"
    open_end = {"upto": fixed if upper else "CAST(0 AS double)", "from": "CAST(NULL AS double)" if upper else fixed}
    return (
        f"CASE {kind_sql} WHEN 'hourly' THEN {fixed} * {HOURS} WHEN 'daily' THEN {fixed} * {DAYS} "
        f"WHEN 'usd' THEN {first} * {USD} WHEN 'usd_range' THEN {other} * {USD} WHEN 'range' THEN {span} * ({unit}) "
        f"WHEN 'upto' THEN {open_end['upto']} WHEN 'from' THEN {open_end['from']} WHEN 'fixed' THEN {fixed} END"
    )


def compare(q: Spark, want_kind: str, want_min: str, want_max: str, kind_: str, lo: str, hi: str) -> str:
    """How well an offer meets a wish: 70 and 75 for negotiable ones, 50 without figures, 100 within, 95 above, else by the ratio, at least 20."""
    wish = f"coalesce(nullif({want_max}, 0), {want_min})"
    top = f"coalesce(nullif({hi}, 0), {lo})"
    ratio = f"CASE WHEN {wish} > 0 THEN {top} / {wish} ELSE 0 END"
    return (
        f"CASE WHEN {want_kind} = 'negotiable' THEN CAST(70 AS double) WHEN {kind_} = 'negotiable' THEN CAST(75 AS double) "
        f"WHEN {want_min} IS NULL OR {lo} IS NULL THEN CAST(50 AS double) WHEN {lo} <= {wish} AND {wish} <= {top} THEN CAST(100 AS double) "
        f"WHEN {lo} >= {wish} THEN CAST(95 AS double) WHEN {top} < {wish} THEN greatest(CAST(20 AS double), ({ratio}) * 85) ELSE CAST(60 AS double) END"
    )


#: Amounts in millions.
MILLIONS = r"(\d+(?:[.,]\d+)?)\s*(?:triệu|tr(?:[^\p{L}\p{N}_]|$))"
MILLION_SPAN = r"(\d+(?:[.,]\d+)?)\s*[-~]\s*(\d+(?:[.,]\d+)?)\s*(?:triệu|tr(?:[^\p{L}\p{N}_]|$))"


def stated_millions(q: Spark, x: str) -> str:
    """The amounts in VND a text states in millions: both ends of a span, or else all single ones."""
    t = f"lower(coalesce({x}, ''))"
    num = lambda s: q.double(f"replace({s}, ',', '.')") + " * 1000000"
    both = f"array({num(q.ext(t, MILLION_SPAN, 1))}, {num(q.ext(t, MILLION_SPAN, 2))})" if type(q) is Spark else f"[{num(q.ext(t, MILLION_SPAN, 1))}, {num(q.ext(t, MILLION_SPAN, 2))}]"
    return f"CASE WHEN {q.match(t, MILLION_SPAN)} THEN {both} ELSE {q.map(q.extall(t, MILLIONS), 'm', num('m'))} END"


def repaired(q: Spark, ref: str, lo: str, hi: str, upper: bool) -> str:
    """The lower or upper figure of the columns, put right by the stated amounts ``ref`` (an array) where they are five times it or more."""
    low, high = (f"array_min({ref})", f"array_max({ref})") if type(q) is Spark else (f"list_min({ref})", f"list_max({ref})")
    n = q.size(ref)
    low_wrong = f"({n} > 0 AND {lo} > 0 AND {low} / {lo} >= 5)"
    if upper:
        fixed = (
            f"CASE WHEN {n} > 0 AND {hi} > 0 AND {high} / {hi} >= 5 THEN {high} WHEN {low_wrong} AND {n} > 1 THEN {high} "
            f"WHEN {hi} IS NULL AND {n} > 1 THEN {high} ELSE {hi} END"
        )
    else:
        fixed = f"CASE WHEN {low_wrong} THEN {low} WHEN {lo} IS NULL AND {n} > 0 THEN {low} ELSE {lo} END"
    return f"CASE WHEN ({fixed}) <> 0 AND ({fixed}) < 1000000 THEN ({fixed}) * 10 ELSE ({fixed}) END"
