"""Names of provinces, the one list all operators on places take."""

from __future__ import annotations

from ..functions.columns import ACCENTED, BASE

FOLD = str.maketrans(ACCENTED + ACCENTED.upper(), BASE + BASE.upper())
#: Fixed values (public geography): the provinces and cities an address may end in.
PROVINCES = """Hà Nội|Hải Phòng|Quảng Ninh|Bắc Ninh|Hải Dương|Hưng Yên|Vĩnh Phúc|Thái Nguyên|Bắc Giang|Nam Định|Thái Bình|Hà Nam|Ninh Bình|Phú Thọ|Hòa Bình|Lào Cai|Yên Bái|Lạng Sơn|Tuyên Quang|Sơn La|Điện Biên|Cao Bằng|Hà Giang|Bắc Kạn|Lai Châu|Đà Nẵng|Thanh Hóa|Nghệ An|Hà Tĩnh|Quảng Bình|Quảng Trị|Thừa Thiên Huế|Quảng Nam|Quảng Ngãi|Bình Định|Phú Yên|Khánh Hòa|Ninh Thuận|Bình Thuận|Kon Tum|Gia Lai|Đắk Lắk|Đắk Nông|Lâm Đồng|Hồ Chí Minh|Bình Dương|Đồng Nai|Bà Rịa - Vũng Tàu|Tây Ninh|Bình Phước|Long An|Tiền Giang|Bến Tre|Trà Vinh|Vĩnh Long|Đồng Tháp|An Giang|Kiên Giang|Cần Thơ|Hậu Giang|Sóc Trăng|Bạc Liêu|Cà Mau""".split("|")


def fold(s: str) -> str:
    """Without the accents of Vietnamese, case kept."""
    return s.translate(FOLD)


#: The same in lower case, without accents and dashes.
FOLDED = [" ".join(fold(p).lower().replace("-", " ").split()) for p in PROVINCES]
