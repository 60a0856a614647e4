"""Postal addresses that denote one house, however written.

An address is parsed into house number, street, ward, district and city; words
are expanded by a locale's dictionary, the order of the parts doesn't matter.
Missing cities follow from the district (each belongs to one city, learned from
the rows that state both) or, without one, from a house and street that occur
in one city only.  Records are joined on the keys city, house number, street;
streets are compared through shared deletion variants, so that one slip of the
pen is forgiven where one of the words is not itself a common word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ACCENTED, BASE
from ..sources.tables import cut
from .places import FOLDED, fold

#: Other ways of writing a city.
CITY_NAMES = {c: c for c in FOLDED} | {c.replace(" ", ""): c for c in FOLDED} | {"hcm": "ho chi minh", "hcmc": "ho chi minh", "tphcm": "ho chi minh", "sai gon": "ho chi minh", "saigon": "ho chi minh", "hn": "ha noi", "brvt": "ba ria vung tau", "br vt": "ba ria vung tau", "hue": "thua thien hue", "vung tau": "ba ria vung tau", "ba ria": "ba ria vung tau", "dac lac": "dak lak"}
_COUNTRY = {"viet nam", "vietnam", "vn"}
_HOUSE = r"\d+[a-z]?(?:/\d+[a-z]?)*(?![\w/])"
_NUMBER_WORD = r"(?:(?:nha\s+)?so(?:\s+nha)?|sn|no|number|nha)\s*\.?\s*"
_NUMBERED = re.compile(rf"^{_NUMBER_WORD}(?=\d)")
_LEAD = re.compile(rf"^(?:{_NUMBER_WORD})?({_HOUSE})\s*(.*)$")
_TRAIL = re.compile(rf"^(.*?)\s+(?:{_NUMBER_WORD})({_HOUSE})$")
_STREET_WORD = re.compile(r"^(?:duong pho|duong|pho|street|str|d(?=\s*\.)|d(?=\s))\s*\.?\s*")
_WARD = re.compile(r"^(?:phuong|ward|p|f|w)\s*\.?\s*(\d+)$")
_CITY_WORD = re.compile(r"^(?:thanh pho|tp|t\.p|tinh|city|province)\s*\.?\s*")
_DISTRICT_WORD = re.compile(r"^(?:quan|huyen|thi xa|q|h|tx)(?:\s*\.\s*|\s+)")
_PLACE_PART = re.compile(r"^(?:tang|lau|floor|fl)\s*\.?\s*\d|^toa(?:\s+nha)?\s|(?:building|tower)$|^(?:building|tower|block|khu)\s")


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits between two words, a swap of neighbours counting once; ``most + 1`` if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        before, last = last, row
    return min(last[-1], most + 1)


@lru_cache(maxsize=200_000)
def city_of(name: str) -> tuple[str, int]:
    """The city meant by a folded name and the edits it took; empty if none comes near."""
    name = re.sub(r"[^a-z ]+", " ", name)
    name = " ".join(name.split())
    if name in CITY_NAMES:
        return CITY_NAMES[name], 0
    if len(name) < 4:
        return "", 9
    most = 1 if len(name) < 9 else 2
    best = sorted((distance(name, k, most), k) for k in CITY_NAMES if len(k) > 4 and abs(len(k) - len(name)) <= most)
    best = [b for b in best if b[0] <= most]
    if not best or len({CITY_NAMES[k] for d, k in best if d == best[0][0]}) > 1:
        return "", 9
    return CITY_NAMES[best[0][1]], best[0][0]


def _segments(t: str) -> list[str]:
    t = re.sub(r"(b[àa]\s*r[ịi]a)\s*[-–]\s*(v[ũu]ng)", r"\1 \2", t)
    t = re.sub(r"(r[a-zịi]{0,3}a?)\s+[-–]\s+(v[ũu]ng\s)", r"\1 \2", t)
    return [x.strip(" .") for x in re.split(r"[,;|\n]|\s[-–]\s", t) if x.strip(" .")]


def _clean(name: str) -> str:
    return " ".join(re.sub(r"[^\w]+", " ", name).split())


def parse(address: str | None) -> tuple:
    """``house, street, street_plain, ward, district, city, city_edits``; empty strings for what is missing.

    ``street`` and ``district`` keep their accents, ``street_plain`` tells that
    the address is written without any.  An address without a house number or
    street has them empty and is never matched.
    """
    t = unicodedata.normalize("NFC", address or "").lower().replace("​", "")
    t = " ".join(t.split())
    house = street = ward = district = city = ""
    city_edits, loose = 9, []
    segs = _segments(t)
    waiting = False
    for s in segs:
        f = fold(s)
        if f in _COUNTRY or _PLACE_PART.search(f):
            continue
        if m := _WARD.match(f):
            ward = ward or m.group(1)
            continue
        bare = _CITY_WORD.sub("", f)
        c, e = city_of(bare)
        if c and (bare != f or e == 0) and not _NUMBERED.match(f):
            if not city or e < city_edits:
                city, city_edits = c, e
            continue
        words = f.split()
        d = _DISTRICT_WORD.match(f)
        if d:
            district = district or s[d.end() :]
            continue
        if len(words) > 1 and distance(words[-1], "district", 2) <= 2:
            district = district or " ".join(s.split()[:-1])
            continue
        if len(words) > 1 and len(words[0]) >= 3 and distance(words[0], "quan", 1) <= 1 and words[0] not in ("quang", "xuan") and not re.search(r"\d", f):
            district = district or " ".join(s.split()[1:])
            continue
        if not house:
            if (m := _LEAD.match(f)) and (_NUMBERED.match(f) or f[:1].isdigit()):
                house = m.group(1)
                rest = s[len(s) - len(m.group(2)) :] if m.group(2) else ""
                street = _bare_street(rest)
                waiting = not street
                continue
            if m := _TRAIL.match(f):
                house, street = m.group(2), _bare_street(s[: len(m.group(1))])
                continue
        if waiting:
            street, waiting = _bare_street(s), False
            continue
        if re.match(r"^(?:duong|pho|d\s*\.)", f) and not street:
            street = _bare_street(s)
            continue
        loose.append(s)
    for s in loose:
        f = fold(s)
        bare = _CITY_WORD.sub("", f)
        c, e = city_of(bare)
        tail = next((t for k in (4, 3, 2) if len(f.split()) > k and (t := " ".join(f.split()[-k:])) in CITY_NAMES), "")
        if not city and (tail or (c and (bare != f or (e <= 1 and len(loose) > 1)))):
            city, city_edits = (CITY_NAMES[tail], 1) if tail else (c, e)
        elif not district and bare == f and not re.search(r"\d", f):
            district = s
        elif c and not city:
            city, city_edits = c, e
    if not city and district:
        c, e = city_of(fold(district))
        if c and e == 1:
            city, city_edits = c, 5  # uncertain: a district's city goes first
    plain = t == fold(t)
    return house, _clean(street), plain, ward, _clean(district), city, city_edits


def _bare_street(s: str) -> str:
    f = fold(s)
    m = _STREET_WORD.match(f)
    return s[m.end() :] if m else s


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = list(map(parse, batch.column("address").to_pylist()))
        cols = list(zip(*got)) if got else [()] * 7
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["id", "house", "street", "plain", "ward", "district", "city", "city_edits"])


def _keys(c: Column) -> Column:
    """A string and what is left of it without one letter."""
    one = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), c.substr(i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), one))


def slips(words: DataFrame, ratio: int = 15) -> DataFrame:
    """``word, right``: words of ``words`` (``word, n``) that are one edit from a word at least ``ratio`` times as frequent, with the most frequent such."""
    near = words.select("word", "n", F.explode(_keys(F.col("word"))).alias("k"))
    pairs = near.join(words.select(F.col("word").alias("right"), F.col("n").alias("m"), F.explode(_keys(F.col("word"))).alias("k")), "k")
    pairs = pairs.where((F.col("word") != F.col("right")) & (F.col("m") >= ratio * F.col("n")))
    one = (F.levenshtein("word", "right") <= 1) | ((F.length("word") == F.length("right")) & (F.array_sort(F.split("word", "")) == F.array_sort(F.split("right", ""))))
    return pairs.where(one).groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right"))


def corrected(rows: DataFrame, column: str) -> DataFrame:
    """``column, plain, right_form, odd_words`` of each distinct string of ``column``: with slips put right word by word, and the words that were slips.

    What is written without accents is held against all words without theirs.
    """
    out = None
    for plain in (False, True):
        word = F.translate("word", ACCENTED, BASE) if plain else F.col("word")
        counted = rows if plain else rows.where(~F.col("plain"))
        words = counted.select(F.explode(F.split(column, " ")).alias("word")).where("word <> ''").groupBy(word.alias("word")).agg(F.count("*").alias("n"))
        each = rows.where(F.col("plain") == plain).select(column).distinct().select(column, F.posexplode(F.split(column, " ")).alias("at", "word")).join(slips(words), "word", "left")
        # the words of one string
        parts = each.groupBy(column).agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("right", "word").alias("w")))).alias("ws"), F.collect_set(F.when(F.col("right").isNotNull(), F.col("word"))).alias("odd_words"))
        part = parts.select(column, F.lit(plain).alias("plain"), F.array_join(F.col("ws.w"), " ").alias("right_form"), "odd_words")
        out = part if out is None else out.unionByName(part)
    return out


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose streets agree word by word, with one slip in a word that isn't common."""
    for batch in batches:
        keep = []
        for sa, sb, ra, rb, pa_, pb, odd_a, odd_b in zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "ra", "rb", "pa", "pb", "odd_a", "odd_b"))):
            keep.append(streets_agree(ra, rb, pa_, pb, set(), set()) or streets_agree(sa, sb, pa_, pb, set(odd_a or ()), set(odd_b or ())))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def streets_agree(a: str, b: str, plain_a: bool, plain_b: bool, odd_a: set, odd_b: set) -> bool:
    if plain_a or plain_b:
        a, b, odd_a, odd_b = fold(a), fold(b), set(map(fold, odd_a)), set(map(fold, odd_b))
    if a == b:
        return True
    x, y = a.split(), b.split()
    if len(x) != len(y):
        joined = distance(a.replace(" ", ""), b.replace(" ", ""), 1) == 0
        return joined or (bool(odd_a or odd_b) and distance(a, b, 1) <= 1)
    slipped = 0
    for p, q in zip(x, y):
        if p != q:
            if not (p in odd_a or q in odd_b) or distance(p, q, 2) > (2 if p in odd_a and q in odd_b else 1):
                return False
            slipped += 1
    return slipped <= 2


def same_houses(cache: DataFrame, key: str, address: str) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: ``id, class_id`` of the parsed rows and ``a < b``, linked classes.

    A class is one way of writing city, house number and street.  Rows without a
    house number, a street or a city that can be told belong to none.  Null and
    empty addresses belong to none.  Of a repeated id the row counts whose city
    is surest, then the least in order.
    """
    rows = cache.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(address).cast("string").alias("address"))
    rows = rows.mapInArrow(_parts, "id bigint, house string, street string, plain boolean, ward string, district string, city string, city_edits int")
    rows = rows.where("house <> '' and street <> ''")
    best = F.min(F.struct("city_edits", "district", "house", "street", "plain", "ward", "city"))
    rows = cut(rows.groupBy("id").agg(best.alias("r")).select("id", "r.*"))
    folded = lambda c: F.translate(c, ACCENTED, BASE)
    # districts: slips corrected, then the city most rows state for it
    fixed = corrected(rows.where("district <> ''"), "district").select("district", "plain", "right_form")
    rows = rows.join(fixed, ["district", "plain"], "left").withColumn("district", F.coalesce("right_form", "district")).drop("right_form")
    rows = cut(rows)
    sure = rows.where("city_edits <= 2 and district <> ''")
    by_name = sure.groupBy("district", "city").count().groupBy("district").agg(F.max_by("city", F.struct("count", "city")).alias("home"))
    by_fold = sure.groupBy(folded("district").alias("df"), "city").count().groupBy("df").agg(F.max_by("city", F.struct("count", "city")).alias("home_f"))
    rows = rows.join(by_name, "district", "left").withColumn("df", folded("district")).join(by_fold, "df", "left")
    home = F.when(F.col("plain"), F.coalesce("home_f", "home")).otherwise(F.coalesce("home", "home_f"))
    stated = F.when(F.col("city_edits") == 0, F.col("city"))
    rows = rows.withColumn("city", F.coalesce(stated, home, F.when(F.col("city") != "", F.col("city")))).withColumn("sf", folded("street"))
    # no district either: the only city that has this house and street
    only = rows.where("city is not null").groupBy("house", "sf").agg(F.min("city").alias("lo"), F.max("city").alias("hi")).where("lo = hi").select("house", "sf", F.col("lo").alias("only_city"))
    rows = rows.join(only, ["house", "sf"], "left").withColumn("city", F.coalesce("city", "only_city")).where("city is not null")
    rows = cut(rows.select("id", "city", "house", "street", "sf", "plain"))
    classes = rows.groupBy("city", "house", "street", "sf", "plain").agg(F.min("id").alias("class_id"))
    classes = cut(classes.join(corrected(rows, "street"), ["street", "plain"]))
    members = rows.join(classes.select("city", "house", "street", "plain", "class_id"), ["city", "house", "street", "plain"]).select("id", "class_id")
    spread = classes.select("city", "house", "class_id", "street", "right_form", "plain", "odd_words", F.explode(F.array_union(_keys(F.col("sf")), F.array(folded("right_form")))).alias("k"))
    left = spread.select("city", "house", "k", F.col("class_id").alias("a"), F.col("street").alias("sa"), F.col("right_form").alias("ra"), F.col("plain").alias("pa"), F.col("odd_words").alias("odd_a"))
    right = spread.select("city", "house", "k", F.col("class_id").alias("b"), F.col("street").alias("sb"), F.col("right_form").alias("rb"), F.col("plain").alias("pb"), F.col("odd_words").alias("odd_b"))
    near = left.join(right, ["city", "house", "k"]).where("a < b").dropDuplicates(["a", "b"])
    pairs = near.select("a", "b", "sa", "sb", "ra", "rb", "pa", "pb", "odd_a", "odd_b").mapInArrow(_same, "a bigint, b bigint")
    return cut(members), cut(pairs)
