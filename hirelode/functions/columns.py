"""Helpers over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``df`` with ``cols`` added (or replaced), each computed once per row.

    A Project would be merged into those above it, so a column used ten times
    would be computed ten times; a Generate of one row is a border to that.
    """
    rest = [F.col(c) for c in df.columns if c not in cols]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


#: The letters of Vietnamese with their base letters.
_LETTERS = {
    "a": "àáạảãâầấậẩẫăằắặẳẵ",
    "e": "èéẹẻẽêềếệểễ",
    "i": "ìíịỉĩ",
    "o": "òóọỏõôồốộổỗơờớợởỡ",
    "u": "ùúụủũưừứựửữ",
    "y": "ỳýỵỷỹ",
    "d": "đ",
}
ACCENTED = "".join(_LETTERS.values())
BASE = "".join(k * len(v) for k, v in _LETTERS.items())


def folded(c: Column) -> Column:
    """Lower-cased, without accents and combining marks; ``đ`` is ``d``."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, BASE), r"\p{M}", "")
