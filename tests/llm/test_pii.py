import unicodedata

from hirelode.llm.pii import find_personal, findings, redacted


def found(text):
    return [(k, text[a:b]) for a, b, k in find_personal(text)]


def test_kinds():
    assert found("Người giới thiệu Lê Thị Hoa, CCCD số 0079.1234.5678, thường trú 191A/2 đường Hoa Sữa, phường 4, quận Tân Phú, Hà Nội.") == [("name", "Lê Thị Hoa"), ("id_number", "0079.1234.5678"), ("address", "191A/2 đường Hoa Sữa, phường 4, quận Tân Phú, Hà Nội")]
    assert found("Gặp chị Hương (hr.h@a-b.example, (+84) 912 345 678).") == [("name", "Hương"), ("email", "hr.h@a-b.example"), ("phone", "(+84) 912 345 678")]
    assert found("mail tien.to a còng abc chấm example hoặc x(at)y(dot)test") == [("email", "tien.to a còng abc chấm example"), ("email", "x(at)y(dot)test")]
    assert found("gọi không chín một hai ba bốn năm sáu bảy tám nhé, hay O756 705 434") == [("phone", "không chín một hai ba bốn năm sáu bảy tám"), ("phone", "O756 705 434")]
    assert found("ở 46 duong con voi, phuong 6, kim son, ha noi. Xong") == [("address", "46 duong con voi, phuong 6, kim son, ha noi")]


def test_what_does_not_count():
    for t in ("Mã số thuế doanh nghiệp 0433375321.", "Tổng đài 1900 1258 hoạt động 24/7.", "https://x.example/tin/0912345678", "Hợp đồng mẫu số 355/2026/HĐLĐ-40901.", "Đại diện ở Bà Rịa - Vũng Tàu", "Ứng viên chưa biết HTML5", "Làm tại quận 1, Hà Nội", "Chi nhánh X gần chợ Dương Xỉ.", "Sơn La RỒI", "Lưu TRỮ hồ sơ", "Lô hàng số 86422677 giao đợt 23.", "", None):
        assert find_personal(t) == []


def test_decomposed_text_keeps_its_places():
    t = unicodedata.normalize("NFD", "Trú tại 264 đường Giếng Ổi, phường 8, quận An Quế, Thanh Hóa. Gặp anh Đức.")
    assert [unicodedata.normalize("NFC", v) for _, v in found(t)] == ["264 đường Giếng Ổi, phường 8, quận An Quế, Thanh Hóa", "Đức"]


def test_tables(spark):
    rows = [(1, "Gọi 0912345678, HR: Nhi (0912 345 678)", None, "x"), (2, None, "", "y"), (3, "dài " * 30000 + "a@b.example", "HR: NHI (84912345679)", "z")]
    df = spark.createDataFrame(rows, "job_id bigint, d string, r string, kind string")
    f = findings(df, "job_id", ["d", "r"])
    assert {(r.job_id, r.kind, r.value_text) for r in f.collect()} == {(1, "phone", "0912345678"), (1, "phone", "0912 345 678"), (1, "name", "Nhi"), (3, "email", "a@b.example"), (3, "name", "NHI"), (3, "phone", "84912345679")}
    assert redacted(df, "job_id", ["d", "r"]).where("job_id = 1").collect()[0].d == "Gọi [PHONE], HR: [NAME] ([PHONE])"
    assert findings(df.limit(0), "job_id", ["d", "r"]).count() == 0


def test_no_text_is_skipped_for_its_form():
    hangul = unicodedata.normalize("NFD", "한국어 회사")
    assert found("Gọi 0912345678 " + hangul) == [("phone", "0912345678")]
    assert found(hangul + unicodedata.normalize("NFD", " gặp chị Hương ") + "\u0344\u1109\u0300x, a@b.example")[-1] == ("email", "a@b.example")
