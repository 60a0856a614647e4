import math
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TEXTS = ("p2_", "p3_", "p4_", "p5_", "p6_", "p8_", "p9_", "p10_")  # these have tests of their own


def _value(x):
    if x is None or type(x).__name__ in ("NAType", "NaTType") or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(map(_value, x))
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return bool(x)
    try:
        return round(float(x), 6) + 0.0 if not isinstance(x, str) else x
    except (TypeError, ValueError):
        return str(x)


def _rows(frame):
    return sorted((tuple(_value(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def check(data):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


GENERAL = [n for n in entry.queries() if not n.startswith(TEXTS)]


@pytest.mark.parametrize("name", [n for n in GENERAL if n in entry.oracle_sql()])
def test_sql_agrees_in_every_value(spark, data, check, name):
    mine, other = entry.queries()[name](spark, data).toPandas(), check.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(mine.columns) == sorted(other.columns)
    assert _rows(mine) == _rows(other)


#: The least number of rows of queries without SQL, on the smallest tables.
LEAST = {"p1_found": 900, "p1_value_counts": 100, "p7_found": 90, "p7_units": 90, "diverse_select": 100, "knn_lsh": 40, "semantic_match": 2000, "scored_batches": 1000}


@pytest.mark.parametrize("name", [n for n in GENERAL if n not in entry.oracle_sql()])
def test_queries_without_sql_give_rows(spark, data, name):
    assert entry.queries()[name](spark, data).count() >= LEAST[name]


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).collect()


def test_nothing_else_needs_the_text_package():
    """The library works without its text operators."""
    code = "import sys; sys.modules['hirelode.llm'] = None; import __spark_entry__ as e, hirelode.api; assert 'p1_found' in e.queries() and 'p2_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
    for folder, _, names in os.walk(os.path.join(ROOT, "hirelode")):
        for n in names:
            if n.endswith(".py") and not folder.endswith("llm"):
                text = open(os.path.join(folder, n), encoding="utf-8").read()
                assert "hirelode.llm" not in text and "from .llm" not in text and "from ..llm" not in text, n
