import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from hirelode.sources import files
from hirelode.sources.tables import shared_dir

ODD = [("a, \"b\"", "u1", "dòng 1\ndòng 2", " lùi vào "), (None, "u2", "\\", "x\\"), ("", "u3", "\"", "“”")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, True, 1) for r in ODD], "title string, url string, job_details string, overview string, is_expired boolean, more int")
    path = str(tmp_path / "out")
    files.append_csv(df, path, files.RAW_SCHEMA.names)
    files.append_csv(df.limit(1), path, files.RAW_SCHEMA.names)
    back = files.read_csv(spark, path, files.RAW_SCHEMA)
    assert back.columns == files.RAW_SCHEMA.names
    got = sorted(((r.title, r.url, r.job_details, r.overview, r.is_expired) for r in back.collect()), key=lambda r: r[1])
    assert got == [(*ODD[0], True)] * 2 + [(None, *ODD[1][1:], True), (None, *ODD[2][1:], True)]


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "x.csv").write_text('title,url,n\n"hai\ndòng",u,7\n', encoding="utf-8-sig")
    got = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert got.columns == ["title", "url", "n"] and got.collect()[0].asDict() == {"title": "hai\ndòng", "url": "u", "n": 7}


def test_score_sheets_and_points(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.json").write_text(json.dumps({"metadata": {"annotator": "x"}, "annotations": [{"cv_id": "c", "relevance_score": 7, "other": 1}, {"cv_id": "d", "annotator": "y"}]}, indent=1))
    (tmp_path / "a" / "2.json").write_text(json.dumps({"metadata": {"annotator": "z"}, "annotations": []}))
    got = {(r.cv_id, r.annotator, r.relevance_score) for r in files.read_score_sheets(spark, str(tmp_path / "a")).collect()}
    assert got == {("c", "x", 7), ("d", "y", None)}
    (tmp_path / "p.json").write_text(json.dumps({"Hà Nội": {"lat": 21.0, "lng": 105.8}, "gone": None}))
    assert {(r.company_address, r.lat) for r in files.read_point_map(spark, str(tmp_path / "p.json")).collect()} == {("Hà Nội", 21.0), ("gone", None)}


def _workbook(rows):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = sorted({c for r in rows for c in r if isinstance(c, str)})
    cell = lambda i, j, c: "" if c is None else f'<c r="{chr(65 + j)}{i}" t="s"><v>{shared.index(c)}</v></c>' if isinstance(c, str) else f'<c r="{chr(65 + j)}{i}"><v>{c}</v></c>'
    sheet = "".join(f'<row r="{i}">' + "".join(cell(i, j, c) for j, c in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(_workbook([["về bảng"], ["uri", "tên", "mã"], ["u1", "Kế toán", 11], ["u2", None, "x"]]))
    got = files.read_workbooks(spark, str(tmp_path), ["uri", "title", "code"], first_row=3).collect()
    assert [tuple(r) for r in got] == [("u1", "Kế toán", "11"), ("u2", None, "x")]


def test_documents(spark, tmp_path):
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body><w:p><w:r><w:t>Kinh </w:t></w:r><w:r><w:t>nghiệm {"x" * 120}</w:t></w:r></w:p><w:p><w:r><w:t>hai</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("ngắn")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in files.read_documents(spark, str(tmp_path), {"pdf": lambda b: "từ bên ngoài " * 20}).collect()}
    assert got["a.docx"].startswith("Kinh nghiệm xxx") and got["a.docx"].endswith("\nhai") and got["b.docx"] == got["c.txt"] == "" and got["d.pdf"].startswith("từ")
    assert [r.a for r in spark.createDataFrame([(x,) for x in ("a.PDF", "b.exe", "pdf", None, "x.y.docx")], "n string").select(files.allowed_file(F.col("n")).alias("a")).collect()] == [True, False, False, False, True]


def test_patience_and_cache(spark):
    calls, waits = [], []

    def fetch(key):
        calls.append(key)
        if len(calls) < 3:
            raise files.TooMany
        return {"label": key.upper()}

    assert files.fetch_with_patience(fetch, "a", wait=waits.append) == {"label": "A"} and waits == [1.0, 2.0]
    assert files.fetch_with_patience(lambda k: 1 / 0, "a", wait=waits.append) is None
    keys = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("none",)], "uri string")
    cache = spark.createDataFrame([("a", "held", "x"), ("z", "other", "y")], "uri string, label string, uri2 string")
    got = files.enriched(keys, "uri", cache, lambda k: None if k == "none" else {"label": k * 2}, ["label"], tries=1)
    assert {(r.uri, r.label) for r in got.collect()} == {("a", "held"), ("b", "bb"), ("none", None)}


def test_logs_and_points(spark):
    log = spark.createDataFrame([(i, i % 3) for i in range(9)] + [(99, None)], "id int, at int")
    assert [r.id for r in files.retained_log(log, "at", 4, "id").collect()] == [2, 5, 8, 1]
    pts = spark.createDataFrame([("1", "2"), (None, "2"), (" ", "1"), ("nan", "1")], "a string, b string")
    assert [r.m for r in pts.select(files.missing_point("a", "b").alias("m")).collect()] == [False, True, True, True]


class _Unset:
    """A context or session on a cluster whose settings name no folder."""

    master, _hirelode_shipped = "spark://elsewhere:7077", True
    sparkContext = conf = _jsc = property(lambda self: self)

    def get(self, name, default=None):
        return default

    def isEmpty(self):
        return True

    getConf = sc = getCheckpointDir = lambda self: self


def test_no_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        shared_dir(_Unset())
