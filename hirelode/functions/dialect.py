"""SQL expressions written once and rendered for Spark or for the engine of the correctness check.

A scalar operator is a function from a dialect and column names to SQL text; in
Spark the text becomes a Column by ``F.expr`` and takes part in Catalyst's plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import ACCENTED, BASE


class Spark:
    """Text for Spark SQL."""

    #: Starts a pattern that ignores case, accented letters included.
    any_case = "(?iu)"

    @staticmethod
    def lit(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def match(self, x: str, p: str) -> str:
        return f"regexp_like({x}, {self.lit(p)})"

    def repl(self, x: str, p: str, r: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r)})"

    def ext(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract({x}, {self.lit(p)}, {g})"

    def extall(self, x: str, p: str, g: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)}, {g})"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, {self.lit(p)}, -1)"

    def map(self, a: str, v: str, body: str) -> str:
        return f"transform({a}, {v} -> {body})"

    def filter(self, a: str, v: str, body: str) -> str:
        return f"filter({a}, {v} -> {body})"

    def at(self, a: str, i: int) -> str:
        return f"get({a}, {i})"

    def size(self, a: str) -> str:
        return f"size({a})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def date(self, x: str) -> str:
        return f"to_date(try_to_timestamp({x}, 'd/M/yyyy'))"

    def overlap(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})"

    def common(self, a: str, b: str) -> str:
        return f"size(array_intersect({a}, {b}))"

    def distinct(self, a: str) -> str:
        return f"array_distinct({a})"

    def double(self, x: str) -> str:
        return f"try_cast({x} AS double)"


class Check(Spark):
    """Text for DuckDB."""

    any_case = "(?i)"

    @staticmethod
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def match(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.lit(p)})"

    def repl(self, x: str, p: str, r: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(p)}, {self.lit(r.replace('$', chr(92)))}, 'g')"

    def split(self, x: str, p: str) -> str:
        return f"regexp_split_to_array({x}, {self.lit(p)})"

    def map(self, a: str, v: str, body: str) -> str:
        return f"list_transform({a}, lambda {v}: {body})"

    def filter(self, a: str, v: str, body: str) -> str:
        return f"list_filter({a}, lambda {v}: {body})"

    def at(self, a: str, i: int) -> str:
        return f"({a})[{i + 1}]"

    def size(self, a: str) -> str:
        return f"len({a})"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {self.lit(sep)})"

    def date(self, x: str) -> str:
        return f"try_strptime({x}, '%d/%m/%Y')::date"

    def overlap(self, a: str, b: str) -> str:
        return f"list_has_any({a}, {b})"

    def common(self, a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))"

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})"


SPARK, CHECK = Spark(), Check()


def column(sql: str) -> Column:
    return F.expr(sql)


def fold(q: Spark, x: str) -> str:
    """Lower case without accents."""
    return f"translate(lower({x}), {q.lit(ACCENTED)}, {q.lit(BASE)})"


def text(q: Spark, x: str) -> str:
    """Trimmed, with null and the word ``nan`` as the empty text."""
    return f"CASE WHEN {x} IS NULL OR lower(trim({x})) = 'nan' THEN '' ELSE trim({x}) END"


def has_any(q: Spark, x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q.lit(w)})" for w in words) + ")"
