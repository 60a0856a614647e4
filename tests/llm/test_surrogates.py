import unicodedata

import pytest

from hirelode.llm import queries
from hirelode.llm.pii import findings, find_personal
from hirelode.llm.places import fold
from hirelode.llm.surrogates import canonical, identities, identity, pseudonymised, surrogates, written_as

ONE = {
    "phone": ["0912345678", "(+84) 912 345 678", "O912.345.678", "0084 912345678", "không chín một hai ba bốn năm sáu bảy tám", "KHONG CHIN MOT HAI BA BON NAM SAU BAY TAM", "zero nine one two three four five six seven eight"],
    "email": ["an.nt@abc-x.example", "An.NT [at] abc-x (dot) example", "an.nt a còng abc-x chấm example", "AN.NT@ABC-X.EXAMPLE"],
    "id_number": ["079123456789", "079 123 456 789", "079.123.456-789"],
    "name": ["Lê Thị Hương", "LÊ THỊ HƯƠNG", "Le Thi Huong", "lê thị hương"],
    "address": ["191A/2 đường Hoa Sữa, phường 4, quận Tân Phú, Hà Nội", "191a/2 duong hoa sua - phuong 4 - quan tan phu - ha noi", "191A/2 ĐƯỜNG HOA SỮA, PHƯỜNG 4, QUẬN TÂN PHÚ, HÀ NỘI"],
}


@pytest.mark.parametrize("kind", ONE)
def test_every_spelling_keeps_its_form(kind):
    canon = {canonical(kind, v) for v in ONE[kind]}
    assert len(canon) == 1
    (canon,) = canon
    made = identity("key", kind, canon, "f", 0)
    assert made == identity("key", kind, canon, "f", 0) != identity("other", kind, canon, "f", 0)
    for v in ONE[kind]:
        out = written_as(kind, canon, made, v)
        assert out != v and canonical(kind, out) == canonical(kind, made), (v, out)  # coreference
        assert out.isupper() == v.isupper() and out.islower() == v.islower() and out.isascii() == v.isascii(), (v, out)
        if kind in ("phone", "id_number"):
            assert [c for c in out if not c.isalnum()] == [c for c in v if not c.isalnum()]
    wide = unicodedata.normalize("NFD", ONE[kind][0])
    assert unicodedata.is_normalized("NFD", written_as(kind, canon, made, wide))


def test_gender():
    women = {fold(identity("k", "name", f"le x{i}", "f", 0).split()[-1]) for i in range(50)}
    men = {fold(identity("k", "name", f"le x{i}", "m", 0).split()[-1]) for i in range(50)}
    from hirelode.llm.surrogates import WOMEN

    assert women <= WOMEN and not men & WOMEN


def test_distinct_and_never_real(spark):
    """More single names than there are to draw from; some data are what others would get."""
    names = [f"Ten{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    first = [identity("key", "name", canonical("name", n), None, 0).title() for n in names[:50]]
    rows = [("name", n, None) for n in [*names, *first]]
    made = identities(spark.createDataFrame(rows, "kind string, value_text string, gender string"), "key").collect()
    forms = [canonical("name", r.made) for r in made]
    assert len(set(forms)) == len(forms) == len({canonical("name", n) for _, n, _ in rows}) and not set(forms) & {r.canon for r in made}


def test_a_datum_keeps_its_surrogate_from_table_to_table(spark):
    kinds = "kind string, value_text string, gender string"
    one = spark.createDataFrame([("name", f"Ten{chr(97 + i)}", None) for i in range(20)], kinds)
    known = identities(one, "key")
    more = one.unionByName(spark.createDataFrame([("name", f"A{chr(97 + i % 26)}{chr(97 + i // 26)}", None) for i in range(200)], kinds))
    later = {r.canon: r.made for r in identities(more, "key", known).collect()}
    assert all(later[r.canon] == r.made for r in known.collect()) and len(set(later.values())) == len(later)


def test_texts(spark):
    rows = [
        (1, "Gọi 0912345678, gặp chị Hương (0912 345 678).", None, "x"),
        (2, "", "", "y"),
        (3, "dài " * 30000 + "a@b.example", "HR: NHI (84912345678)", "z"),
        (None, "HR: Nhi", None, "q"),
        (3, "Gặp anh Đức", None, None),
    ]
    df = spark.createDataFrame(rows, "job_id bigint, d string, r string, kind string")
    got = pseudonymised(df, "job_id", ["d", "r"], "key").collect()
    assert len(got) == len(rows)
    by = {(k, v): s for k, _, v, s, _ in surrogates(findings(df, "job_id", ["d", "r"]), "key").collect()}
    one = next(x for x in got if x.job_id == 1)
    assert one.d == f"Gọi {by['phone', '0912345678']}, gặp chị {by['name', 'Hương']} ({by['phone', '0912 345 678']})." and one.r is None
    assert by["phone", "0912 345 678"].replace(" ", "") == by["phone", "0912345678"]
    left = {t[a:b] for x in got for t in (x.d, x.r) for a, b, _ in find_personal(t)}
    assert left and not left & {v for _, v in by}
    assert pseudonymised(df.limit(0), "job_id", ["d", "r"], "key").count() == 0


def test_whole_table(spark, data):
    s = queries.QUERIES["p5_surrogates"](spark, data).toPandas()
    nfc = lambda x: unicodedata.normalize("NFC", x)
    assert all(a.isupper() == b.isupper() and a.islower() == b.islower() and nfc(a).isascii() == nfc(b).isascii() for a, b in zip(s.value_text, s.surrogate))
    made = {(k, c): {canonical(k, x) for x in g} for (k, c), g in s.groupby(["kind", "canon"]).surrogate}
    assert all(len(v) == 1 for v in made.values())
    forms = [(k, *v) for (k, _), v in made.items()]
    assert len(set(forms)) == len(forms) and not set(forms) & set(made)
