"""Personal data in running text: found, and replaced by typed placeholders.

``surrogates`` replaces them by made-up data of the same kind and form.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import PROVINCES, fold

_SHORT = ["HCM", "HCMC", "Hanoi", "Haiphong", "Danang", "Cantho", "Daklak", "Daknong", "Huế", "Hue"]
_PLACE = "|".join(sorted({re.escape(p) for x in PROVINCES + _SHORT for p in (x, fold(x))}, key=len, reverse=True))

_SEP = r"[. \t\u00a0\-‑–]"
_AT = r"(?:\s*[@＠]\s*|\s*[\[({]\s*(?:at|a\s*còng|a\s*cong)\s*[\])}]\s*|\s+(?:a\s*còng|a\s*cong)\s+)"
_DOT = r"(?:\.|\s*[\[({]\s*(?:dot|chấm|cham)\s*[\])}]\s*|\s+(?:chấm|cham|dot)\s+)"
_LABEL = r"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?"
EMAIL = re.compile(
    rf"(?i)(?<![\w.+\-])[a-z0-9][\w.+\-]*(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[a-z]{{2,}}|\s+at\s+{_LABEL}(?:\s+(?:dot|chấm|cham)\s+{_LABEL})*\s+(?:dot|chấm|cham)\s+[a-z]{{2,}})(?![\w@])"
)
URL = re.compile(r"(?i)\b(?:https?://|www\.)\S+")
_DIGIT = r"[0-9OoQ]"
PHONE = re.compile(rf"(?<![\w/.,\-+]|\d\s)(?:\(\s*\+?84\s*\)|\+?84|0084|\(0\d{{1,3}}\)|[0O])(?:{_SEP}{{0,2}}(?:\(0\))?[0-9]|(?<=[0-9]){_SEP}?[Oo](?=[0-9 .\-])){{7,11}}(?![\w]|{_SEP}?\d)")
_NUMERAL = r"(?:không|khong|một|mot|mốt|hai|ba|bốn|bon|tư|năm|nam|lăm|sáu|sau|bảy|bay|bẩy|tám|tam|chín|chin|zero|one|two|three|four|five|six|seven|eight|nine)"
SPELLED = re.compile(rf"(?i)(?<!\p{{L}})(?:không|khong|zero|cộng tám bốn)(?:[\s,.\-]+{_NUMERAL}){{8,10}}(?!\p{{L}})")
_IDLABEL = r"(?:CCCD|CMND|CMTND|CMT|GPLX|BHXH|căn\s*cước(?:\s*công\s*dân)?|can\s*cuoc(?:\s*cong\s*dan)?|chứng\s*minh(?:\s*(?:nhân\s*dân|thư))?|chung\s*minh(?:\s*(?:nhan\s*dan|thu))?|(?:số|so)\s*(?:định|dinh)\s*danh(?:\s*(?:cá\s*nhân|ca\s*nhan))?|định\s*danh\s*cá\s*nhân|hộ\s*chiếu|ho\s*chieu|passport|ID\s*(?:card|number|no\.?)|identity\s*(?:card|number)|(?:mã|ma|sổ|so)\s*(?:số\s*)?(?:BHXH|bảo\s*hiểm\s*xã\s*hội)|(?:số|so)\s*(?:giấy\s*tờ|giay\s*to))"
ID = re.compile(rf"(?i)(?<!\p{{L}}){_IDLABEL}\s*(?:\(?(?:số|so|no\.?|number)\)?)?\s*[:.\-#]?\s*(?:là\s+)?((?:[A-Z]\s?\d{{7,8}}|\d{{3,4}}(?:[ .\-]?\d{{3,4}}){{2,3}}|\d{{8,12}}))(?!\d|[.\-]\d)")
NOT_PERSONAL = re.compile(r"(?i)(?:mã\s*số\s*thuế|ma\s*so\s*thue|MST|tax\s*(?:code|id|number)|tổng\s*đài|tong\s*dai|hotline\s*1900|hợp\s*đồng|hop\s*dong|contract|lô\s*hàng|lo\s*hang|đơn\s*hàng|don\s*hang|order|mã\s*tin|ma\s*tin|mã\s*đơn|tài\s*khoản|STK|serial|tiêu\s*chuẩn)(?:\s+\p{Ll}+){0,3}\s*(?:số|so|no\.?)?\s*[:#]?\s*$")
_W = r"\p{Lu}[\p{L}\p{M}]*"
_TITLE = r"(?:anh|chị|chi|cô|co|bạn|ban|ông|ong|bà|ba|thầy|em|Mr\.?|Mrs\.?|Ms\.?|Miss|MR\.?|MS\.?)"
#: Words after which a name stands, and forms of address.
_CUES = """người giới thiệu|nguoi gioi thieu|đứng tên|dung ten|họ tên|họ và tên|ho ten|ho va ten|ứng viên|ung vien|bảo lãnh bởi|bao lanh boi|người phụ trách|nguoi phu trach|người phụ trách hồ sơ|nguoi phu trach ho so|gặp|gap|hr|liên hệ|lien he|contact|ask for|call|nhắn|nhan|gọi|tên|người liên hệ|name|referred by|hiring manager|recruiter""".split("|")
_TITLES = "anh|chị|chi|cô|co|bạn|ban|ông|ong|bà|ba|thầy|em|mr|mr.|mrs|mrs.|ms|ms.|miss".split("|")
_NAMED = re.compile(rf"\s*:?\s*(?:{_TITLE}\s+)?({_W}(?:\s{_W}){{0,4}})(?!\p{{L}})")
_CALLED = re.compile(rf"\s+({_W}(?:\s{_W}){{0,4}})(?!\p{{L}})")
#: Family names.
FAMILY = "Nguyễn|Trần|Lê|Phạm|Hoàng|Huỳnh|Phan|Vũ|Võ|Đặng|Bùi|Đỗ|Hồ|Ngô|Dương|Lý|Đoàn|Trịnh|Đinh|Lương|Ninh|Cù|Vi|Khổng|Thân|Tô|Mai|Đào|Hà|Tạ|Tống|Chu|Cao|Quách|La|Thái|Lưu|Phùng|Vương|Trương|Ông|Kiều|Lâm|Tăng|Hứa|Từ|Nghiêm|Mạc|Triệu|Diệp".split("|")
_FAMILY = "|".join(sorted({y for x in FAMILY for y in (x, x.upper(), fold(x), fold(x).upper())}, key=len, reverse=True))
FULL_NAME = re.compile(rf"(?<!\p{{L}})(?:{_FAMILY})(?:\s{_W}){{1,4}}(?!\p{{L}})")
_PLACES = re.compile(rf"(?<!\p{{L}})(?:{_PLACE})(?!\p{{L}})")
_FIRM = re.compile(r"(?i)(?:công ty|cong ty|tập đoàn|tap doan|kinh doanh|dự án|du an|nhãn hàng|nhan hang|chi nhánh|chi nhanh|thương hiệu|hệ thống|sản phẩm|chợ|gan cho|cầu|bến|công viên|trường|bệnh viện|siêu thị|ngã tư|ngã ba|đường|phố|phường|quận|huyện|street|tòa nhà|toà nhà|TNHH|cổ phần|MTV|một thành viên)\s*:?\s*$")
_NOT_NAME = re.compile(r"(?i)^(?:công ty|phòng|ban|bộ phận|hr|zalo|email|mail|sđt|đt|cv|khi|qua|theo|tại|số|the|our|us|hotline|hành chính|nhân sự)$")
_HOUSE = r"\d{1,4}(?:bis|ter|[A-Za-z](?!\p{L}))?(?:/\d{1,4}[A-Za-z]?)*"
_PIECE = r"[\p{L}\p{M}\d. /]{1,40}?"
_BAR = r"\s*(?:,|;|\s[-–]\s)\s*"
_STREETISH = r"(?:đường|duong|phố|pho|ngõ|ngo|hẻm|hem|ngách|kiệt|đ\.|Đ\.|đại lộ|\p{Lu})"
ADDRESS = re.compile(
    rf"(?<![\w/.,])(?:(?:{_HOUSE})(?:\s*,\s*|\s+)(?={_STREETISH}))(?:(?i:ngõ|ngo|hẻm|hem|ngách|kiệt)\s+\d+(?:/\d+)*(?:\s*,\s*|\s+))*{_PIECE}(?:{_BAR}{_PIECE}){{0,5}}?{_BAR}(?i:(?:thành\s*phố|thanh\s*pho|tp|tỉnh|tinh|t)\.?\s*)?(?i:{_PLACE})(?:\s+(?:City|Province|city|province))?(?![\p{{L}}\p{{M}}])"
)
ADDRESS_ANY = re.compile(ADDRESS.pattern.replace(f"(?={_STREETISH})", r"(?=\p{L})"), re.IGNORECASE)
_AFTER_HOME = re.compile(r"(?i)(?:thường\s*trú|thuong\s*tru|trú\s*tại|tru\s*tai|(?<!\p{L})tại|(?<!\p{L})ở|ở\s*gần|địa\s*chỉ|room\s+is\s+at|mới)\s*:?\s*(?:số\s*(?:nhà)?|so\s*(?:nha)?|no\.?)?\s*$")
KINDS = ("email", "phone", "id_number", "address", "name")


def _triggers() -> ahocorasick.Automaton:
    """Phrases of lower case, found in one pass, that tell which searches a text needs and where names may follow."""
    found: dict[str, set[str]] = {}
    for kind, words in (
        ("email", ["@", "＠", "còng", "a cong", "(at)", "[at]", "{at}", " dot ", " chấm ", " cham "]),
        ("url", ["://", "www."]),
        ("id", "cccd|cmnd|cmt|căn cước|can cuoc|chứng minh|chung minh|định danh|dinh danh|hộ chiếu|ho chieu|passport|giấy tờ|giay to|bhxh|bảo hiểm xã hội|id card|id number|id no|identity|gplx".split("|")),
        ("spelled", [f"{z} {w}" for z in ("không", "khong", "zero", "tám", "bốn") for w in _NUMERALS]),
        ("cue", _CUES),
        ("title", _TITLES),
        ("home", "thường trú|thuong tru|trú tại|tru tai|tại|ở|ở gần|địa chỉ|room is at|mới".split("|")),
    ):
        for w in words:
            found.setdefault(w, set()).add(kind)
    a = ahocorasick.Automaton()
    for w, kinds in found.items():
        a.add_word(w, (len(w), frozenset(kinds)))
    a.make_automaton()
    return a


_NUMERALS = "không một mốt hai ba bốn tư năm lăm sáu bảy bẩy tám chín khong mot bon nam sau bay tam chin one two three four five six seven eight nine zero".split()
_TRIGGERS = _triggers()
_HOME_GAP = re.compile(r"(?i)\s*:?\s*(?:(?:số|so)\s*(?:nhà|nha)?|no\.?)?\s*(?=\d)")
_SENTENCE = re.compile(r"(?:^|[.!?\n•+*\-]|<br>)\s*$")


def find_personal(text: str | None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of each personal datum in reading order, without overlaps.

    An identity number counts by its label only, a telephone number by its form;
    numbers after the words for tax, service line, order, contract or advert
    don't count.  Null and empty texts have none.
    """
    if not text:
        return []
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        return _placed_back(text)
    return _searched(text)


def _searched(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    needs: set[str] = set()
    after: list[tuple[int, int, frozenset]] = []
    for end, (size, kinds) in _TRIGGERS.iter(low):
        needs |= kinds
        start, end = end + 1 - size, end + 1
        if kinds & {"cue", "title", "home"} and not low[start - 1 : start].isalpha() and not low[end : end + 1].isalpha():
            after.append((start, end, kinds))
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))

    def take(a: int, b: int, kind: str) -> None:
        if a < b and not any(taken[a:b]):
            taken[a:b] = b"\x01" * (b - a)
            if kind:
                found.append((a, b, kind))

    if "email" in needs or " at " in low:
        for m in EMAIL.finditer(text):
            take(*m.span(), "email")
    if "url" in needs:
        for m in URL.finditer(text):
            take(*m.span(), "")
    if "id" in needs:
        for m in ID.finditer(text):
            take(*m.span(1), "id_number")
    # an address doesn't run across other data
    clear = "".join("\x00" if t else c for c, t in zip(text, taken)) if any(taken) else text
    for m in ADDRESS.finditer(clear):
        take(*m.span(), "address")
    for start, end, kinds in after:
        if "home" in kinds and (gap := _HOME_GAP.match(clear, end)) and (m := ADDRESS_ANY.match(clear, gap.end())):
            take(*m.span(), "address")
    for m in PHONE.finditer(text):
        digits = re.sub(r"\D", "", m.group().replace("O", "0").replace("o", "0"))
        local = re.sub(r"^(?:00)?84", "0", digits) if not digits.startswith("0") or digits.startswith("0084") else digits
        local = "0" + local[2:] if local.startswith("00") else local
        if 10 <= len(local) <= 11 and not NOT_PERSONAL.search(text[max(0, m.start() - 50) : m.start()]):
            take(*m.span(), "phone")
    if "spelled" in needs:
        for m in SPELLED.finditer(text):
            take(*m.span(), "phone")
    for start, end, kinds in after:
        cue = "cue" in kinds
        if not cue and "title" not in kinds:
            continue
        word = low[start:end].rstrip(".")
        if not cue and text[start].isupper() and word not in ("mr", "mrs", "ms", "miss"):
            # a capital letter makes a form of address only where a sentence begins, and "Ông", "Bà" are names or places too
            if word not in ("anh", "chị", "cô", "bạn") or not _SENTENCE.search(text[max(0, start - 4) : start]):
                continue
        m = (_NAMED if cue else _CALLED).match(text, end)
        if not m or (cue and m.start(1) == end):
            continue
        a, b = m.span(1)
        place = _PLACES.match(text, a)
        if not _NOT_NAME.match(text[a:b].split()[0]) and not (place and place.end() >= b) and not _FOLLOWED.match(text, b):
            take(a, b, "name")
    for m in FULL_NAME.finditer(text):
        inside = any(x.start() <= m.start() < x.end() for x in _PLACES.finditer(text, max(0, m.start() - 20), m.end()))
        cases = {w.isupper() for w in m.group().split()}  # a name is in one case throughout
        if len(cases) == 1 and not inside and not _FIRM.search(text[max(0, m.start() - 30) : m.start()]) and not _FOLLOWED.match(text, m.end()):
            take(*m.span(), "name")
    return sorted(found)


_FOLLOWED = re.compile(r"\s*(?:['’&]|\d)")
_CLUSTER = re.compile(r"\X")


def _placed_back(text: str) -> list[tuple[int, int, str]]:
    """Findings of the composed form of ``text``, at their places in ``text``.

    A text whose composed form isn't that of its clusters one by one is searched
    as it is written.
    """
    parts, starts, ends, at = [], [], [], 0
    for c in _CLUSTER.findall(text):
        one = unicodedata.normalize("NFC", c)
        parts.append(one)
        starts += [at] * len(one)
        at += len(c)
        ends += [at] * len(one)
    whole = "".join(parts)
    if unicodedata.normalize("NFC", whole) != whole:
        return _searched(text)
    return [(starts[a], ends[b - 1], kind) for a, b, kind in _searched(whole)]


#: Forms of address of a woman and of a man.
_MS = re.compile(r"(?i)(?<!\p{L})(?:chị|chi|cô|co|bà|ba|mrs\.?|ms\.?|miss)\s*$")
_MR = re.compile(r"(?i)(?<!\p{L})(?:anh|ông|ong|thầy|mr\.?)\s*$")


def addressed(text: str, start: int) -> str | None:
    """``f`` or ``m`` by the form of address that stands before ``start``."""
    before = unicodedata.normalize("NFC", text[max(0, start - 12) : start])
    return "f" if _MS.search(before) else "m" if _MR.search(before) else None


def findings(jobs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, field_name, kind, value_text, n, gender``: each distinct datum of a cell as written, how often it stands there, and the gender (``f, m``) a form of address before a name tells."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("cell")) for f in fields])
    cells = jobs.select(F.col(key), F.inline(pairs)).where("cell is not null and cell <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, kinds, values, genders = [], [], [], []
            for i, t in enumerate(batch.column("cell").to_pylist()):
                for a, b, kind in find_personal(t):
                    row.append(i)
                    kinds.append(kind)
                    values.append(t[a:b])
                    genders.append(addressed(t, a) if kind == "name" else None)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(at), batch.column("field_name").take(at), *[pa.array(x, pa.string()) for x in (kinds, values, genders)]], names=[key, "field_name", "kind", "value_text", "gender"]
            )

    kind = dict(jobs.dtypes)[key]
    raw = cells.mapInArrow(run, f"{key} {kind}, field_name string, kind string, value_text string, gender string")
    return raw.groupBy(key, "field_name", "kind", "value_text").agg(F.count("*").alias("n"), F.max("gender").alias("gender"))


def redacted(jobs: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key`` and the fields with each datum replaced by its kind in brackets (``[PHONE]``); null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(key)]
            for f in fields:
                cols.append(pa.array([replaced(t, lambda kind, _: f"[{kind.upper()}]") for t in batch.column(f).to_pylist()], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[key, *fields])

    kind = dict(jobs.dtypes)[key]
    return jobs.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{f} string" for f in fields))


def replaced(text: str | None, by) -> str | None:
    """``text`` with each datum replaced by what ``by`` makes of its kind and writing."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in find_personal(text):
        out += [text[at:a], by(kind, text[a:b])]
        at = b
    return "".join([*out, text[at:]])
