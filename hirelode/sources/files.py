"""Records from and to files: CSV, JSON, workbooks, documents, run logs."""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .tables import shipped

_TEXT = "title url company company_address company_size company_field overview job_details crawled_date content_hash deadline".split()
#: A crawl as it is written: everything is text but the flag.
RAW_SCHEMA = StructType([StructField(n, StringType()) for n in _TEXT]).add("is_expired", "boolean")
SCORE_SHEET = (
    "struct<metadata:struct<annotator:string,total_annotations:int,timestamp:string>,annotations:array<struct<cv_id:string,cv_level:string,cv_category:string,job_id:string,job_title:string,"
    "rank:int,es_score:double,relevance_score:int,skills_match:int,experience_match:int,education_match:int,justification:string,annotator:string,timestamp:string>>>"
)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A CSV with a header: quoted fields may hold line breaks and doubled quotes, a byte order mark is skipped.

    Without a schema types are inferred, at the cost of a second pass.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def append_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """``fields`` of ``df`` appended as CSV, in this order; other columns are left out, missing ones are empty.

    Each file has the header, so that the folder reads as one table.
    """
    cols = [F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]
    df.select(*cols).write.mode("append").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_score_sheets(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Score sheets, one JSON object a file (or a line) with its list of scores: a row per score, the sheet's annotator where a score names none."""
    schema = StructType.fromDDL(f"x {SCORE_SHEET}")["x"].dataType
    sheets = spark.read.schema(schema).option("multiLine", one_per_file).json(path)
    rows = sheets.select(F.col("metadata.annotator").alias("_by"), F.inline("annotations"))
    return rows.withColumn("annotator", F.coalesce("annotator", "_by")).drop("_by")


def read_point_map(spark: SparkSession, path: str) -> DataFrame:
    """``company_address, lat, lng`` of one JSON object that maps addresses to points."""
    whole = spark.read.text(path, wholetext=True)
    points = F.from_json("value", "map<string,struct<lat:double,lng:double>>")
    return whole.select(F.explode(points).alias("company_address", "p")).select("company_address", "p.lat", "p.lng")


def retained_log(log: DataFrame, at: str, kept: int, *ties: str) -> DataFrame:
    """The ``kept`` last entries of a log: the retention is the feature."""
    return log.orderBy(F.desc_nulls_last(at), *ties).limit(kept)


def missing_point(lat: str, lng: str) -> F.Column:
    """Whether a point is missing: either part null, blank or the text ``nan``."""
    gone = lambda c: F.col(c).isNull() | F.lower(F.trim(F.col(c).cast("string"))).isin("", "nan")
    return gone(lat) | gone(lng)


def allowed_file(name: F.Column, endings: Sequence[str] = ("pdf", "doc", "docx")) -> F.Column:
    """Whether a file's name has one of the endings, in any case; a name without a dot has none."""
    return F.coalesce(name.contains(".") & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*endings), F.lit(False))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def sheet_rows(data: bytes, first_row: int) -> list[list[str | None]]:
    """The rows of a workbook's first sheet from ``first_row`` on (counted from 1), cells by position."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_MAIN}row"):
            if int(row.get("r", len(out) + first_row)) < first_row:
                continue
            cells: dict[int, str | None] = {}
            for c in row.iter(f"{_MAIN}c"):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                v, inline = c.find(f"{_MAIN}v"), c.find(f"{_MAIN}is")
                text = "".join(t.text or "" for t in inline.iter(f"{_MAIN}t")) if inline is not None else None if v is None else v.text
                cells[at - 1 if letters else len(cells)] = shared[int(text)] if c.get("t") == "s" and text is not None else text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return out


def read_workbooks(spark: SparkSession, path: str, columns: Sequence[str], first_row: int = 2) -> DataFrame:
    """The first sheets of the workbooks below ``path`` as text columns by position; a workbook is a task's work, rows are streamed on."""
    shipped(spark)
    n = len(columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for data in f["content"]:
                rows = [(r + [None] * n)[:n] for r in sheet_rows(bytes(data), first_row)]
                yield pd.DataFrame(rows, columns=list(columns), dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def document_text(name: str, data: bytes, readers: dict[str, Callable[[bytes], str]] | None = None, least: int = 100) -> str:
    """The text of a document by its ending: Word and plain text are read here, others by ``readers``; under ``least`` letters it is none."""
    ending = name.rsplit(".", 1)[-1].lower()
    try:
        if readers and ending in readers:
            text = readers[ending](data)
        elif ending == "docx":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                body = ElementTree.fromstring(z.read("word/document.xml"))
            text = "\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in body.iter(f"{_WORD}p"))
        elif ending in ("txt", "md"):
            text = data.decode("utf-8-sig", "replace")
        else:
            text = ""
    except Exception:  # a broken file has no text
        text = ""
    return text if len(text.strip()) >= least else ""


def read_documents(spark: SparkSession, path: str, readers: dict[str, Callable[[bytes], str]] | None = None, least: int = 100) -> DataFrame:
    """``path, text`` of the files below ``path``; see :func:`document_text`."""
    shipped(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": [document_text(p, bytes(c), readers, least) for p, c in zip(f["path"], f["content"])]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


class TooMany(Exception):
    """Raised by a fetcher that is asked too often."""


def fetch_with_patience(fetch: Callable[[str], dict | None], key: str, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> dict | None:
    """What ``fetch`` gives, asked again after 1, 2, 4 … seconds where it is asked too often and after one where it fails; None in the end."""
    for attempt in range(tries):
        try:
            return fetch(key)
        except TooMany:
            wait(2.0**attempt)
        except Exception:
            wait(1.0)
    return None


def enriched(keys: DataFrame, key: str, cache: DataFrame, fetch: Callable[[str], dict | None], fields: Sequence[str], tries: int = 3) -> DataFrame:
    """``key`` and ``fields`` of each distinct key: from ``cache`` where it stands there, else fetched in the partitions; what can't be had is null."""
    asked = keys.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()
    held = cache.select(F.col(key).cast("string").alias(key), *fields).dropDuplicates([key])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [fetch_with_patience(fetch, k, tries) or {} for k in f[key]]
            yield pd.DataFrame({key: f[key], **{x: pd.Series([g.get(x) for g in got], dtype=object) for x in fields}})

    new = asked.join(held.select(key), key, "left_anti").mapInPandas(run, f"`{key}` string, " + ", ".join(f"`{x}` string" for x in fields))
    old = held.join(asked, key, "left_semi").select(key, *[F.col(x).cast("string").alias(x) for x in fields])
    return old.unionByName(new)
