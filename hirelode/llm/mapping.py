"""Freely typed values mapped to the entries of a reference list.

Distinct cells are split into tokens; each distinct token is joined to the
reference vocabulary by edit distance (through shared deletion variants, an
equi-join); the corrected tokens of a cell are combined into soft TF-IDF scores
of entries over windows of neighbouring tokens, cosines with the norms of both
sides; the best entry is taken, or none.  An entry of which tokens are missing
counts if those that stand there are spelled right.  Phrases that are known and
not in the list compete as entries of their own, so that a value close to an
entry but meaning another place stays unmatched; they and the other names of
entries are a table that the caller may give.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import evaluated, folded


@dataclass(frozen=True)
class Vocabulary:
    """What is known of a list beside its entries.

    ``aliases``: other names of entries; ``outside``: phrases that mean no entry.
    ``threshold``: least share of an entry's weight that its window must reach.
    """

    aliases: Mapping[str, Sequence[str]] = field(default_factory=dict)
    outside: Sequence[str] = ()
    threshold: float = 0.7
    glue: bool = True
    initials: bool = True


#: Fixed values (public geography): provinces by their finer places and short names.
PLACES = Vocabulary(
    aliases={
        "Hồ Chí Minh": ["HCM", "TPHCM", "HCMC", "TP HCM", "Sài Gòn", "Saigon", "SG", "Thủ Đức", "Tân Bình", "Bình Thạnh", "Gò Vấp", "Phú Nhuận", "Củ Chi", "Hóc Môn", "Nhà Bè", "Bình Chánh", "Bình Tân"],
        "Hà Nội": ["HN", "Hanoi", "Cầu Giấy", "Đống Đa", "Thanh Xuân", "Hoàng Mai", "Nam Từ Liêm", "Bắc Từ Liêm", "Hà Đông", "Long Biên", "Ba Đình", "Hoàn Kiếm", "Hai Bà Trưng", "Thủ đô"],
        "Hải Phòng": ["HP"],
        "Đà Nẵng": ["ĐN", "Danang", "Hải Châu", "Sơn Trà"],
        "Bà Rịa - Vũng Tàu": ["BRVT", "BR VT", "Vũng Tàu", "Bà Rịa"],
        "Thừa Thiên Huế": ["Huế", "TT Huế", "TP Huế"],
        "Đồng Nai": ["Biên Hòa", "Long Thành"],
        "Bình Dương": ["Thủ Dầu Một", "Dĩ An", "Thuận An"],
        "Khánh Hòa": ["Nha Trang", "Cam Ranh"],
        "Lâm Đồng": ["Đà Lạt", "Dalat", "Bảo Lộc"],
        "Đắk Lắk": ["Buôn Ma Thuột", "BMT", "Đắc Lắc", "Daklak"],
        "Đắk Nông": ["Đắc Nông", "Gia Nghĩa"],
        "Bình Định": ["Quy Nhơn"],
        "Phú Yên": ["Tuy Hòa"],
        "Gia Lai": ["Pleiku"],
        "Nghệ An": ["TP Vinh", "thành phố Vinh"],
        "Quảng Ninh": ["Hạ Long", "Cẩm Phả", "Móng Cái"],
        "Phú Thọ": ["Việt Trì"],
        "Quảng Bình": ["Đồng Hới"],
        "Quảng Trị": ["Đông Hà"],
        "Quảng Nam": ["Hội An", "Tam Kỳ"],
        "Bình Thuận": ["Phan Thiết"],
        "Bình Phước": ["Đồng Xoài"],
        "Tiền Giang": ["Mỹ Tho"],
        "Kiên Giang": ["Rạch Giá", "Phú Quốc"],
        "An Giang": ["Long Xuyên", "Châu Đốc"],
        "Đồng Tháp": ["Cao Lãnh", "Sa Đéc"],
        "Long An": ["Tân An"],
        "Cần Thơ": ["Ninh Kiều", "Tây Đô"],
        "Lào Cai": ["Sa Pa", "Sapa"],
        "Điện Biên": ["Điện Biên Phủ"],
        "Hòa Bình": ["Hoà Bình"],
    },
    outside=[
        "Hà Giang", "Bắc Kạn", "Lai Châu", "Ninh Thuận", "Hậu Giang", "Phan Rang", "Vị Thanh",
        "Toàn quốc", "Nhiều tỉnh thành", "Remote", "Đông Nam Bộ", "Tây Nam Bộ", "Tây Nguyên", "Miền Bắc", "Miền Trung", "Miền Nam", "Bắc Trung Bộ", "Nam Trung Bộ", "Duyên hải miền Trung",
        "Đồng bằng sông Cửu Long", "Đồng bằng sông Hồng", "Tây Bắc", "Đông Bắc", "Nước ngoài", "Singapore", "Bangkok", "Tokyo", "Osaka", "Seoul", "Taipei", "Đài Loan", "Nhật Bản", "Hàn Quốc", "Phnom Penh", "Vientiane", "Viêng Chăn", "Kuala Lumpur", "Online", "Làm từ xa", "Tại nhà", "Miền Tây", "Miền Đông", "Thỏa thuận", "Theo dự án", "Đang cập nhật", "Khi phỏng vấn", "Làm việc từ xa", "Campuchia",
    ],
    threshold=0.55,
)
#: Names of schooling levels.
LEVELS = Vocabulary(
    aliases={
        "Đại học": ["ĐH", "D.H", "Cử nhân", "Bachelor", "Bachelor's degree", "University", "University degree", "Undergraduate", "Undergraduate degree", "Kỹ sư"],
        "Cao đẳng": ["CĐ", "C.Đ", "College", "College diploma", "Associate degree", "Cao đẳng nghề"],
        "Trung cấp": ["TC", "TCCN", "T.C", "Vocational", "Vocational school", "Intermediate", "Trung cấp nghề"],
        "Trung học": ["THPT", "PTTH", "THCS", "Trung học phổ thông", "High school", "High-school diploma", "Secondary school", "Lớp 12", "12/12", "Cấp 3", "Cấp III", "Phổ thông", "Tốt nghiệp cấp 3", "Lớp 10", "Lớp 11", "10/12", "11/12"],
        "Không yêu cầu": ["Không cần", "Không bắt buộc", "Không đòi hỏi", "Không cần bằng cấp", "Miễn bằng cấp", "No degree required", "Not required", "No requirement", "No requirements", "None", "Ko yêu cầu", "K yêu cầu", "Không y/c", "Ko y/c", "Không"],
    },
    outside=["Sau đại học", "Trên đại học", "Thạc sĩ", "Thạc sỹ", "Tiến sĩ", "Tiến sỹ", "Master", "Master degree", "MBA", "PhD", "Postgraduate", "Doctor", "Doctorate", "Phó giáo sư", "Giáo sư", "Khác", "Other", "Đang cập nhật", "Trao đổi khi phỏng vấn", "Xem mô tả", "Chứng chỉ", "Chứng chỉ nghề", "Chứng chỉ ngắn hạn", "Sơ cấp", "Sơ cấp nghề", "?"],
    initials=False,
)


def _without_one(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), c.substr(i + 1, F.length(c))))


def _variants(c: Column) -> Column:
    """A token and what is left of it without one letter or, from three letters on, without two."""
    one = _without_one(c)
    two = F.when(F.length(c) >= 3, F.flatten(F.transform(one, _without_one))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(c), one, two))


def _tokens(c: Column) -> Column:
    """Folded tokens of letters and digits; a join of words by capitals (``ThaiNguyen``) is parted."""
    parted = F.regexp_replace(c, r"(?<=\p{L}\p{Ll})(?=\p{Lu}\p{Ll})", " ")
    return F.regexp_extract_all(folded(parted), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _plain(c: Column) -> Column:
    """A token typed by keyboard codes for accents (doubled vowels, w, a tone letter at the end) as its base letters."""
    s = F.regexp_replace(c, "dd", "d")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "aa", "a"), "ee", "e"), "oo", "o")
    return F.regexp_replace(F.regexp_replace(s, "w", ""), "[sfrxj]$", "")


def vocabulary_table(spark: SparkSession, known: Vocabulary) -> DataFrame:
    """``phrase, entry``: other names of entries, and phrases that mean none (a null entry)."""
    rows = [(a, name) for name, names in known.aliases.items() for a in names] + [(o, None) for o in known.outside]
    return spark.createDataFrame(rows, "phrase string, entry string")


def entry_tokens(spark: SparkSession, entries: Sequence[tuple[int, str]], names: Sequence[tuple[str, str | None]], glue: bool) -> DataFrame:
    """``entry_no, ref_id, n, k, token, weight``: the tokens of each phrase with their inverse document frequencies."""
    rows = [(rid, name, False) for rid, name in entries if name and name.strip()]
    ids: dict[str, list[int]] = {}
    for rid, name, _ in rows:
        ids.setdefault(name, []).append(rid)
    rows += [(rid, phrase, True) for phrase, entry in names if entry is not None for rid in ids.get(entry, ())]
    rows += [(0, phrase, False) for phrase, entry in names if entry is None]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "entry_no int, ref_id int, phrase string, is_alias boolean")
    d = d.withColumn("toks", F.array_distinct(F.array(_tokens(F.col("phrase")), F.array(F.array_join(_tokens(F.col("phrase")), "")))))
    d = d.select("entry_no", "ref_id", "is_alias", F.posexplode("toks").alias("form", "toks"))
    d = d.where(F.col("form") == 0) if not glue else d.where((F.col("form") == 0) | (F.length(F.col("toks")[0]) >= 5))
    d = d.select("entry_no", "ref_id", "is_alias", "form", F.size("toks").alias("n"), F.posexplode("toks").alias("k", "token"))
    idf = d.where("form = 0").groupBy("token").agg(F.count_distinct("ref_id").alias("df"))
    total = len({r for r, _, _ in rows}) or 1
    return d.join(F.broadcast(idf), "token", "left").select(  # at most the tokens of the list
        "entry_no", "ref_id", "is_alias", "form", "n", "k", "token", F.log(F.lit(total + 1.0) / F.coalesce("df", F.lit(1))).alias("weight")
    )


def repaired_tokens(tokens: DataFrame, vocabulary: DataFrame, initials: bool) -> DataFrame:
    """``token, ref_token, sim``: each distinct token with the vocabulary's tokens within two edits (one each side of a deletion)."""
    v = vocabulary.select(F.col("token").alias("ref_token")).distinct()
    t = tokens.select("token").distinct()
    left = t.select("token", F.explode(F.array_distinct(F.array("token", _plain(F.col("token"))))).alias("form")).where("form <> ''")
    # what is longer than the longest word by more than two letters is more than two edits from all of them
    longest_word = v.agg(F.max(F.length("ref_token"))).collect()[0][0] or 0
    left = left.where(F.length("form") <= longest_word + 2)
    left = left.select("token", "form", F.explode(_variants(F.col("form"))).alias("key"))
    right = v.select("ref_token", F.explode(_variants(F.col("ref_token"))).alias("key"))
    near = left.join(right, "key").select("token", "form", "ref_token").distinct()
    far = F.levenshtein("form", "ref_token")
    longest = F.greatest(F.length("form"), F.length("ref_token"))
    swapped = (F.length("form") == F.length("ref_token")) & (F.array_sort(F.split("form", "")) == F.array_sort(F.split("ref_token", ""))) & (far == 2)
    edits = F.when(swapped, 1).otherwise(far)
    sim = F.when(far == 0, F.when(F.col("form") == F.col("token"), 1.0).otherwise(0.97)).otherwise(1.0 - 0.9 * edits / longest)
    near = near.where(F.length("ref_token") > 1).withColumn("sim", sim)
    near = near.where(((edits <= 1) & (longest >= 2)) | ((edits == 2) & (longest >= 3)) | (far == 0))
    out = near.groupBy("token", "ref_token").agg(F.max("sim").alias("sim"))
    if initials:
        one = t.where((F.length("token") == 1) & F.col("token").rlike(r"^\p{L}$"))
        first = v.where(F.length("ref_token") > 1).withColumn("token", F.substring("ref_token", 1, 1))
        out = out.unionByName(one.join(first, "token").select("token", "ref_token", F.lit(0.69).alias("sim")))
    single = v.where(F.length("ref_token") == 1).join(t, F.col("token") == F.col("ref_token")).select("token", "ref_token", F.lit(1.0).alias("sim"))
    return out.unionByName(single).groupBy("token", "ref_token").agg(F.max("sim").alias("sim"))


def map_values(cells: DataFrame, value: str, entries: DataFrame, entry_id: str, entry_text: str, known: Vocabulary, names: DataFrame | None = None) -> DataFrame:
    """``value, ref_id, score``: one row per distinct string of ``cells.value``; ``ref_id`` 0 where nothing fits.

    Null, blank and ``nan`` values give no row.  Of windows with equal scores
    the one nearer the end counts (a finer place stands before its city), then
    the longer phrase, then the lower ``ref_id``.  ``entries`` must be a list of
    bounded size, and so must ``names`` (``phrase, entry``, taken in the place of
    the phrases of ``known``): more than 100,000 rows raise ``ValueError``.  With
    no entries every value is 0.
    """
    spark = cells.sparkSession
    listed = [(int(r[0]), r[1]) for r in entries.select(entry_id, entry_text).where(F.col(entry_text).isNotNull()).limit(100_001).collect()]
    if names is None:
        names = vocabulary_table(spark, known)
    named = [(r[0], r[1]) for r in names.where("phrase is not null and trim(phrase) <> ''").select("phrase", "entry").limit(100_001).collect()]
    if len(listed) > 100_000 or len(named) > 100_000:
        raise ValueError("the reference list is beyond the size that is sent to every task")
    phrases = entry_tokens(spark, listed, named, known.glue)
    unknown = math.log(len({r for r, _ in listed}) + 1.0)
    base = cells.select(F.col(value).cast("string").alias("v")).where("v is not null and trim(v) <> '' and lower(trim(v)) <> 'nan'").distinct()
    base = evaluated(base, {"toks": _tokens(F.col("v"))})
    at = base.select("v", F.size("toks").alias("len"), F.posexplode("toks").alias("pos", "token"))
    fixed = repaired_tokens(at, phrases, known.initials)
    hits = at.join(fixed, "token")
    hits = hits.join(F.broadcast(phrases.withColumnRenamed("token", "ref_token")), "ref_token")  # bounded above
    weights = phrases.groupBy("entry_no", "form").agg(F.sum("weight").alias("norm"), F.sum(F.length("token")).alias("letters"))
    hits = hits.withColumn("start", F.col("pos") - F.col("k"))
    per = hits.groupBy("v", "len", "entry_no", "ref_id", "is_alias", "form", "n", "start").agg(
        F.sum(F.col("weight") * F.col("sim")).alias("got"), F.sum("weight").alias("own"), F.count("*").alias("m"), F.max("sim").alias("best_sim"), F.sum(F.length("ref_token")).alias("seen")
    )
    per = per.join(F.broadcast(weights), ["entry_no", "form"])
    # cosine of vectors of roots of idf: both norms, the entry's and that of the window's tokens, of which those that match nothing weigh most
    inside = F.least("n", "len")
    window = F.col("own") + (inside - F.col("m")) * F.lit(unknown)
    cosine = F.col("got") / F.sqrt(F.col("norm") * window)
    per = per.withColumn("score", F.round(cosine - F.when(F.col("form") == 1, 0.02).otherwise(0.0), 6))
    whole = F.col("m") == F.col("n")
    per = per.where(whole | ((F.col("got") >= 0.97 * F.col("own")) & (F.col("seen") > 2) & ~F.col("is_alias") & (F.col("ref_id") > 0)))
    per = per.where((F.col("best_sim") > 0.695) & (~whole | (F.col("letters") > 3) | (F.col("score") >= 0.97)))
    per = per.withColumn("score", F.when(F.col("is_alias") & (F.col("score") < 0.95), F.col("score") - 0.15).otherwise(F.col("score"))).where(F.col("score") >= known.threshold)
    # exactness first, then how much text the phrase explains
    rank = F.struct(
        (F.col("score") * F.least(F.lit(1.0), 0.8 + 0.02 * F.col("letters"))).alias("s"),
        F.col("letters").alias("l"),
        F.col("start").alias("at"),
        (-F.col("ref_id")).alias("r"),
        F.col("score").alias("score"),
    )
    best = per.groupBy("v").agg(F.max(rank).alias("b"))
    return base.select("v").join(best, "v", "left").select(F.col("v").alias(value), F.coalesce(-F.col("b.r"), F.lit(0)).cast("int").alias("ref_id"), F.coalesce(F.col("b.score"), F.lit(0.0)).alias("score"))


LOCATION, EDUCATION = "job_location", "education_level"


def mapped_cells(jobs: DataFrame, city_ref: DataFrame, education_ref: DataFrame) -> DataFrame:
    """``job_id, field_name, ref_id, score`` for each cell of the two fields that isn't blank, ``nan`` or itself an entry."""
    out = None
    for name, ref, text, known in ((LOCATION, city_ref, "city", PLACES), (EDUCATION, education_ref, "education_level", LEVELS)):
        # a value that is an entry letter for letter needs no mapping; the list is small and checked in map_values
        cells = jobs.select("job_id", F.col(name).alias("v")).where("v is not null and trim(v) <> '' and lower(trim(v)) <> 'nan'")
        cells = cells.join(F.broadcast(ref.select(F.col(text).alias("v")).where("v is not null").distinct()), "v", "left_anti")
        found = map_values(cells, "v", ref, "ref_id", text, known)
        part = cells.join(found, "v").select("job_id", F.lit(name).alias("field_name"), "ref_id", "score")
        out = part if out is None else out.unionByName(part)
    return out

