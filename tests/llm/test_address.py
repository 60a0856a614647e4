from hirelode.llm.address import distance, parse, same_houses, streets_agree
from hirelode.llm.neardup import all_pairs


def test_parse():
    assert parse("Tầng 5, Tòa nhà ABC, Số 12B/4 đường Lê Lợi, P.3, Quận Tân Khê, TP. Hà Nam")[:6] == ("12b/4", "lê lợi", False, "3", "tân khê", "ha nam")
    assert parse("TP Tây Ninh , quận Quảng Nhai , F12 , Hoa Táu No. 15/12")[:6] == ("15/12", "hoa táu", False, "12", "quảng nhai", "tay ninh")
    assert parse("61, Đ. Tràng Sim, Ba Ria - Vung Tau - VN")[:6] == ("61", "tràng sim", False, "", "", "ba ria vung tau")
    assert parse(None)[:2] == ("", "") and parse("")[:2] == ("", "") and parse("Quận 1, Hà Nội")[0] == "" and len(parse("x, " * 20000)) == 7


def test_streets():
    assert streets_agree("ao lụa", "ao lụa", False, False, set(), set()) and not streets_agree("ao lụa", "ao lúa", False, False, set(), set())
    assert streets_agree("ao lua", "ao lúa", True, False, set(), set()) and streets_agree("ao lụq", "ao lụa", False, False, {"lụq"}, set())
    assert distance("vườn", "vưnờ") == 1 and distance("a", "abcd", 1) == 2


def test_pairs(spark):
    good = ["Số 12 đường Bến Măng, Phường 3, Quận Tân Khê, Hà Nam", "12 Ben Mang - P.3 - Q. Tan Khe - Ha Nam", "TP. Hà Nam; Tân Khê District; SN 12 Bến Mnăg", "Nhà số 12 Đ. Bến Măng, quận Tân Khê", "Tầng 2, Tòa nhà X, 12, phố Bến Măng, Hanam"]
    other = ["Số 12B đường Bến Măng, Quận Tân Khê, Hà Nam", "Số 12 đường Bến Mận, Quận Tân Khê, Hà Nam", "Số 12 đường Bến Măng, Quận Long Lạc, Hà Nội", None, "", "Hà Nam"]
    filler = [f"Số {i} đường Bến {w}, Quận Tân Khê, Hà Nam" for w in ("Măng", "Mận") for i in range(100, 130)]
    df = spark.createDataFrame(list(enumerate([*good, *other, *filler])), "address_id bigint, company_address string")
    got = {tuple(r) for r in all_pairs(*same_houses(df.selectExpr("*", "'x' as city", "1 as id"), "address_id", "company_address")).collect()}
    assert got == {(a, b) for a in range(5) for b in range(a + 1, 5)}
    members, pairs = same_houses(df.limit(0), "address_id", "company_address")
    assert members.count() == 0 and pairs.count() == 0
