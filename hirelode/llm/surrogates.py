"""Surrogates: made-up personal data in the place of found ones.

One datum, however written, has one canonical form, and for it one made-up
identity is drawn with a secret key (coreference).  The identity is then written
in the way of each spelling: digits in their grouping, words where a number is
spelled out, the marks of a disguised e-mail, accents or none, the case of each
word, so that a surrogate's canonical form is its identity's.  An identity that
is drawn for two data, or is a datum of the table, is drawn again until none is
left (distinctness).
"""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.tables import cut
from .pii import FAMILY, findings, replaced
from .places import FOLDED, fold
from .skew import spread_join

#: Digits by word, by language and script.
_DIGIT_WORDS = {
    "accented": "không một hai ba bốn năm sáu bảy tám chín".split(),
    "plain": "khong mot hai ba bon nam sau bay tam chin".split(),
    "english": "zero one two three four five six seven eight nine".split(),
}
_OTHER_WORDS = {"mốt": 1, "tư": 4, "lăm": 5, "bẩy": 7}
_VALUE = {w: d for ws in _DIGIT_WORDS.values() for d, w in enumerate(ws)} | _OTHER_WORDS
#: Names to draw from; all of them have accents, so that an accented name stays one.
FEMALE = "Hương Thảo Diễm Quyên Sương Miên Yến Hà Ngân Phượng Hạnh Hằng Hồng Huyền Liễu Lý Mỹ Mận Nguyệt Như Phương Quỳnh Thắm Thủy Tuyết Vân Xuân Ánh Đào Cúc Dịu Gấm Hiền Lệ Thoại Thúy Thơ Uyển".split()
MALE = "Bách Dũng Hùng Khải Kiên Sơn Tiến Toàn Tùng Cường Đạt Hải Lâm Bình Chiến Công Đức Giáp Hiếu Hoàng Huân Hưng Khôi Lộc Lực Mạnh Nghĩa Phát Phú Phúc Quân Quốc Quý Tài Tân Thắng Thành Thịnh Trí Trọng Trường Tuấn Việt Vũ Vượng".split()
MIDDLE = "Bảo Cát Chí Diệu Đăng Hạ Hoài Khánh Ngọc Nhã Thục Tố Trúc Uyên Bích Cẩm Đình Hữu Kiều Mộng Quế Thế Trọng Tường".split()
#: Given and middle names usual for women.
WOMEN = frozenset(fold(x).lower() for x in [*FEMALE, "Thị", "Lan", "Mai", "Nga", "Vy", "Nhi", "Trang", "Linh", "Thoa", "Oanh", "Giang", "Hoa", "Huệ", "Liên"])
#: Words of an address that say what follows; they are kept.
_ADDRESS_WORDS = frozenset("so nha duong pho dai lo ngo hem ngach kiet phuong quan huyen thi xa tran thanh tinh tp p q h tx khu street st ward district city province viet nam vietnam".split())
_AT = re.compile(r"(?i)\s*[\[({]?\s*(?:[@＠]|a\s*còng|a\s*cong|(?<![a-z])at(?![a-z]))\s*[\])}]?\s*")
_DOT = re.compile(r"(?i)\s*[\[({]?\s*(?:\.|chấm|cham|(?<![a-z])dot(?![a-z]))\s*[\])}]?\s*")
MAX_ROUNDS = 60


def _lower(value: str) -> str:
    return unicodedata.normalize("NFC", value).lower()


def canonical(kind: str, value: str) -> str:
    """The form in which two ways of writing one datum agree."""
    v = _lower(value)
    if kind == "phone":
        words = [_VALUE[w] for w in re.split(r"[\s,.\-]+", v) if w in _VALUE]
        d = "".join(map(str, words)) if len(words) >= 8 else re.sub(r"\D", "", v.replace("o", "0"))
        return re.sub(r"^(?:00)?84(?=\d{9})", "0", d)
    if kind == "email":
        local, host = _email_parts(v)
        return f"{local}@{'.'.join(host)}"
    if kind == "id_number":
        return re.sub(r"[^a-z0-9]", "", v)
    return re.sub(r"[^a-z0-9/]+", " ", fold(v)).strip()


def _email_parts(v: str) -> tuple[str, list[str]]:
    m = _AT.search(v)
    if not m:
        return re.sub(r"\s", "", v), []
    return re.sub(r"\s", "", v[: m.start()]), [x for x in (re.sub(r"\s", "", y) for y in _DOT.split(v[m.end() :])) if x]


def _numbers(secret: str, *what: object) -> Iterator[int]:
    i, label = 0, "\x1f".join(map(str, what))
    while True:
        yield from hmac.new(secret.encode(), f"{label}\x1f{i}".encode(), hashlib.sha256).digest()
        i += 1


def _same_class(text: str, draw: Iterator[int]) -> str:
    """Digits for digits, letters for letters, other characters kept; a first digit above 0 stays above 0."""
    out = []
    for i, c in enumerate(text):
        n = next(draw)
        if c.isdigit():
            out.append(str(n % 9 + 1 if i == 0 and c != "0" else n % 10) if not (i == 0 and c == "0") else c)
        else:
            out.append(chr(97 + n % 26) if c.isalpha() else c)
    return "".join(out)


def identity(secret: str, kind: str, canon: str, gender: str | None, attempt: int) -> str:
    """The made-up datum of ``canon``: canonical but for accents and case of words.  Later attempts draw anew."""
    draw = _numbers(secret, kind, canon, attempt)
    if kind == "phone":
        return canon[:2] + _same_class("9" * 20, draw)[: max(0, len(canon) - 2)]
    if kind == "id_number":
        return _same_class(canon, draw)
    if kind == "email":
        local, _, host = canon.partition("@")
        labels = host.split(".") if host else []
        return _same_class(local, draw) + "@" + ".".join([*[_same_class(x, draw) for x in labels[:-1]], *labels[-1:]])
    pick = lambda pool: pool[(next(draw) << 8 | next(draw)) % len(pool)].lower()
    parts = canon.split()
    if kind == "name":
        woman = gender == "f" or (gender != "m" and any(p in WOMEN for p in (parts[-1:] + parts[1:2])))
        given = pick(FEMALE if woman else MALE)
        # a single name has few others of its kind: from the third draw on it gets a second word
        middles = [pick(MIDDLE) for _ in range(max(0, len(parts) - 2) if len(parts) > 1 else min(attempt // 2, 4))]
        return " ".join([*([pick(FAMILY)] if len(parts) > 1 else []), *middles, given])
    tail = next((n for n in range(min(5, len(parts)), 0, -1) if " ".join(parts[-n:]) in _CITIES), 0)
    out = []
    for i, w in enumerate(parts):
        if i >= len(parts) - tail or w in _ADDRESS_WORDS:
            out.append(w)
        elif w[0].isdigit():
            out.append("".join(_same_class(c, draw) if c.isdigit() else c for c in w) if len(w) == 1 else _same_numbers(w, draw))
        else:
            out.append(pick(MIDDLE if next(draw) % 2 else MALE))
    return " ".join(out)


_CITIES = frozenset(FOLDED) | {"hcm", "hcmc", "hanoi", "haiphong", "danang", "cantho", "daklak", "daknong", "hue", "vung tau"}


def _same_numbers(w: str, draw: Iterator[int]) -> str:
    """A house number with its digits drawn anew; letters and slashes stay."""
    return re.sub(r"\d+", lambda m: _same_class(m.group(), draw), w)


def _cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if letters and all(c.isupper() for c in letters) and (len(letters) > 1 or len(word) == 1):
        return word.upper()
    return word[:1].upper() + word[1:] if letters and letters[0].isupper() else word


def _scripted(words: Sequence[str], value: str) -> list[str]:
    v = unicodedata.normalize("NFC", value)
    return [fold(w) for w in words] if v == fold(v) else list(words)


def written_as(kind: str, canon: str, made: str, value: str) -> str:
    """The identity ``made`` in the way ``value`` writes ``canon``."""
    v = unicodedata.normalize("NFC", value)
    out = _written(kind, canon, made, v)
    return out if v == value else unicodedata.normalize("NFD", out)


def _written(kind: str, canon: str, made: str, v: str) -> str:
    if kind == "phone":
        own = canon[1:]  # what all spellings share: the leading 0 may be +84
        if sum(w in _VALUE for w in re.split(r"[\s,.\-]+", v.lower())) >= 8:
            pieces = re.split(r"([\s,.\-]+)", v)
            at = [i for i, w in enumerate(pieces) if w.lower() in _VALUE]
            low = v.lower()
            script = "english" if "zero" in low or " one" in low or " two" in low or " eight" in low or " nine" in low else "plain" if low == fold(low) else "accented"
            for i, d in zip(at[-len(own) :], made[1:]):
                pieces[i] = _cased(_DIGIT_WORDS[script][int(d)], pieces[i])
            return "".join(pieces)
        at = [i for i, c in enumerate(v) if c.isdigit() or c in "oO"]
        out = list(v)
        for i, d in zip(at[-len(own) :], made[1:]):
            out[i] = v[i] if d == "0" and v[i] in "oO" else d
        return "".join(out)
    if kind == "id_number":
        drawn = iter(made)
        return "".join(_cased(next(drawn), c) if re.match(r"[a-zA-Z0-9]", c) else c for c in v)
    if kind == "email":
        m = _AT.search(v)
        local, _, host = made.partition("@")
        if not m:
            return local + "@" + host
        labels = host.split(".")
        pieces = re.split(f"({_DOT.pattern.removeprefix('(?i)')})", v[m.end() :], flags=re.IGNORECASE)
        if len(pieces[::2]) != len(labels):
            return local + "@" + host
        pieces[::2] = [_cased(x, y) for x, y in zip(labels, pieces[::2])]
        return _cased(local, v[: m.start()]) + m.group() + "".join(pieces)
    words = _scripted(made.split(), v)
    spelled = v.split() if kind == "name" else re.findall(r"[^\W_]+(?:/[^\W_]+)*|/", v)
    if kind == "name":
        return " ".join(_cased(w, spelled[min(i, len(spelled) - 1)]) for i, w in enumerate(words))
    # an address keeps its marks; words that stay are taken as written
    pieces = re.split(r"([^\W_]+(?:/[^\W_]+)*)", v)
    at = [i for i in range(1, len(pieces), 2)]
    old = canon.split()
    if len(at) != len(words) or len(old) != len(words):
        return " ".join(words)
    for i, w, o in zip(at, words, old):
        if w != o:
            number = w[0].isdigit()
            pieces[i] = (w.upper() if pieces[i].isupper() else w) if number else _cased(w, pieces[i])
    return "".join(pieces)


def identities(found: DataFrame, secret: str, known: DataFrame | None = None) -> DataFrame:
    """``kind, canon, made``: one made-up datum for each datum of ``found`` (``kind, value_text, gender``), no two alike and none a real one.

    What is drawn depends on the key and the datum; only of data that draw the
    same does the least keep it.  So that a datum keeps its identity from one
    table to the next, give the earlier result as ``known``: its rows come first.
    Raises ``RuntimeError`` if :data:`MAX_ROUNDS` draws don't part all data.
    """

    @F.pandas_udf("string")
    def canon(kind: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([canonical(k, v) for k, v in zip(kind, value)], dtype=object)

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, value: pd.Series, gender: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([identity(secret, k, v, g, int(a)) for k, v, g, a in zip(kind, value, gender, attempt)], dtype=object)

    @F.pandas_udf("string")
    def plain(kind: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([canonical(k, v) if k in ("name", "address") else v for k, v in zip(kind, value)], dtype=object)

    told = F.sum(F.when(F.col("gender") == "f", 1).when(F.col("gender") == "m", -1).otherwise(0))
    per = found.groupBy("kind", "value_text").agg(told.alias("told")).withColumn("canon", canon("kind", "value_text"))
    data = per.groupBy("kind", "canon").agg(F.sum("told").alias("told"))
    data = cut(data.select("kind", "canon", F.when(F.col("told") > 0, "f").when(F.col("told") < 0, "m").alias("gender")))
    kept = known.select("kind", "canon", "made") if known is not None else data.select("kind", "canon", F.col("canon").alias("made")).limit(0)
    done = cut(kept)
    left = cut(data.join(done, ["kind", "canon"], "left_anti"))
    real = data.select("kind", F.col("canon").alias("form"))
    attempt = 0
    while left.limit(1).count():
        if attempt == MAX_ROUNDS:
            raise RuntimeError("the surrogates of some data can't be told apart")
        tried = left.withColumn("made", drawn("kind", "canon", "gender", F.lit(attempt))).withColumn("form", plain("kind", "made"))
        used = real.unionByName(done.select("kind", plain("kind", "made").alias("form"))).distinct().withColumn("_used", F.lit(True))
        first = F.row_number().over(W.partitionBy("kind", "form").orderBy("canon")) == 1
        tried = cut(tried.join(used, ["kind", "form"], "left").withColumn("_good", F.col("_used").isNull() & first))
        done = cut(done.unionByName(tried.where("_good").select("kind", "canon", "made")))
        left = cut(tried.where(~F.col("_good")).select("kind", "canon", "gender"))
        attempt += 1
    return done


def surrogates(found: DataFrame, secret: str, known: DataFrame | None = None) -> DataFrame:
    """``kind, canon, value_text, surrogate, n_cells``: the surrogate of each way of writing, in the way it is written."""

    @F.pandas_udf("string")
    def canon(kind: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([canonical(k, v) for k, v in zip(kind, value)], dtype=object)

    @F.pandas_udf("string")
    def spelled(kind: pd.Series, form: pd.Series, made: pd.Series, value: pd.Series) -> pd.Series:
        return pd.Series([written_as(*x) for x in zip(kind, form, made, value)], dtype=object)

    made = identities(found, secret, known)
    values = found.groupBy("kind", "value_text").agg(F.count("*").alias("n_cells")).withColumn("canon", canon("kind", "value_text"))
    both = values.join(made, ["kind", "canon"])
    return both.select("kind", "canon", "value_text", spelled("kind", "canon", "made", "value_text").alias("surrogate"), "n_cells")


def pseudonymised(jobs: DataFrame, key: str, fields: Sequence[str], secret: str, known: DataFrame | None = None) -> DataFrame:
    """``key`` and the fields with each datum replaced by its surrogate; null stays null, the rest of a text stays as it is.

    A datum that a third of the rows hold is met by broadcast (see
    ``skew.spread_join``); the surrogates of one row are brought to it by its key.
    Rows whose key is null or repeated are rows of the result like all others.
    """
    found = cut(findings(jobs, key, fields))
    table = cut(surrogates(found, secret, known).select("kind", "value_text", "surrogate", "n_cells"))
    met = spread_join(found.select(F.col(key).alias("_k"), "kind", "value_text"), table, ["kind", "value_text"], "n_cells", found.count())
    entry = F.struct(F.concat("kind", F.lit("\x1f"), "value_text").alias("k"), F.col("surrogate").alias("s"))
    per = met.groupBy("_k").agg(F.map_from_entries(F.collect_set(entry)).alias("_by"))  # the data of one row
    rows = jobs.select(F.col(key), *[F.col(f).cast("string").alias(f) for f in fields])
    rows = rows.join(per, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, *fields, F.map_entries("_by").alias("_by"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [{e["key"]: e["value"] for e in x} if x else {} for x in batch.column("_by").to_pylist()]
            cols = [batch.column(key)]
            for f in fields:
                texts = zip(batch.column(f).to_pylist(), own)
                cols.append(pa.array([t if not by else replaced(t, lambda kind, v, by=by: by[f"{kind}\x1f{v}"]) for t, by in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[key, *fields])

    kind = dict(jobs.dtypes)[key]
    return rows.mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{f} string" for f in fields))
