"""Several values packed into one cell, brought to one row per value.

Quoted spans, bracketed spans and decimal commas are replaced by indexed
placeholders, so that no mark inside them can be taken for a delimiter; the
remaining text is split; the spans are put back by array lookup; the values are
exploded with their positions.  Everything is built-in Spark SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import evaluated

OPEN, CLOSE, CUT = "\ue000", "\ue001", "\ue002"
#: The three marks above, where a cell itself has them, are spans too: so no cell can collide with a placeholder.
_MARKS = f"[{OPEN}{CLOSE}{CUT}]"
_DOUBLE = r'"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"'
_SINGLE = r"(?<=[\[,\s])'[^'\\]*+(?:\\.[^'\\]*+)*+'(?=\s*[,\]])"
_ROUND = r"\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)"
_DECIMAL = r"(?<![\p{L}\p{N}])\d+,\d+(?![\p{L}\p{N}])"
SPAN = f"(?s)({_MARKS}|{_DOUBLE}|{_ROUND}|{_DECIMAL})"
SPAN_LIST = f"(?s)({_MARKS}|{_DOUBLE}|{_SINGLE}|{_ROUND}|{_DECIMAL})"
DELIMITER = r"(?U)(?:<br\s*/?>|[,;|\n\r\t\u2022\u3001\uff0c\uff1b]|\s+/\s*|\s*/\s+|(?:^|\s)[-\u2013\u2014]\s)"
BULLET = r"(?U)^\s*(?:(?:[-\u2013\u2014*+\u00b7\u25aa\u25cf]|\d{1,2}[.)])\s+)+"
TRIM = r"(?U)^\s+|\s+$"
#: Between two languages these words join, elsewhere they belong to a value.
JOINER = r"(?Uiu)\s+(?:và|va|and|hoặc|or)\s+|\s*&\s*"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, TRIM, "")


def split_packed(df: DataFrame, cell: str, field: str, slash_fields: Sequence[str], joined_fields: Sequence[str]) -> DataFrame:
    """One row per value of the string column ``cell``: its other columns, ``pos_no`` (from 1), ``value_text``.

    ``field`` names the column that holds the field's name: in ``slash_fields``
    a slash without spaces separates, in ``joined_fields`` joining words do.
    Null, blank and ``nan`` cells, and empty places, give no row and are not
    counted.  An unclosed quote or bracket is ordinary text.  Repeated values
    stay.  The result has no row for an empty input.
    """
    keep = [c for c in df.columns if c != cell]
    is_list = F.col("_c").rlike(r"(?s)^\[.*\]$")

    def marked(pat: str) -> Column:
        held = lambda p, i: F.concat(p, F.when(i < F.size("_spans"), F.concat(F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(""))
        return F.array_join(F.transform(F.split("_c", pat, -1), held), "")

    spans = lambda pat: F.regexp_extract_all("_c", F.lit(pat), F.lit(1))
    def value(p: Column) -> Column:
        return _trim(F.regexp_replace(p, BULLET, ""))

    def unwrap(span: Column) -> Column:
        quoted = span.rlike(r'(?s)^(?:".*"|\'.*\')$') & (F.length(span) > 1)
        inner = F.regexp_replace(F.regexp_replace(span.substr(F.lit(2), F.length(span) - 2), '""', '"'), r"\\(.)", "$1")
        return _trim(F.when(quoted, inner).otherwise(span))

    base = evaluated(df.where(F.col(cell).isNotNull()), {"_c": _trim(F.col(cell))}).where((F.col("_c") != "") & (F.lower("_c") != "nan"))
    base = evaluated(base, {"_l": is_list, "_spans": F.when(is_list, spans(SPAN_LIST)).otherwise(spans(SPAN))})
    base = evaluated(base, {"_m": F.when(F.col("_l"), marked(SPAN_LIST)).otherwise(marked(SPAN))})
    bare = F.when(F.col("_l"), F.expr("substring(_m, 2, length(_m) - 2)")).otherwise(F.col("_m"))
    base = evaluated(base, {"_m": F.regexp_replace(bare, DELIMITER, CUT)})
    joined = F.when(F.col(field).isin(*joined_fields), F.regexp_replace("_m", JOINER, CUT)).otherwise(F.col("_m"))
    base = evaluated(base, {"_m": F.when(F.col(field).isin(*slash_fields), F.regexp_replace(joined, "/", CUT)).otherwise(joined)})
    base = evaluated(base, {"_p": F.transform(F.split("_m", CUT, -1), value)})
    values = F.expr(
        "transform(_p, p -> named_struct("
        f"'whole', p rlike '^{OPEN}[0-9]+{CLOSE}$', "
        f"'text', array_join(zip_with(split(p, '{OPEN}[0-9]+{CLOSE}', -1), regexp_extract_all(p, '{OPEN}([0-9]+){CLOSE}', 1), "
        "(a, i) -> concat(a, coalesce(element_at(_spans, cast(i as int) + 1), ''))), '')))"
    )
    base = evaluated(base, {"_t": values})
    shown = F.transform("_t", lambda v: F.when(v["whole"], unwrap(v["text"])).otherwise(v["text"]))
    base = base.withColumn("_v", F.filter(shown, lambda v: v != ""))
    return base.select(*keep, F.posexplode("_v").alias("_pos", "value_text")).select(
        *keep, (F.col("_pos") + 1).cast("int").alias("pos_no"), "value_text"
    )


def fields_as_rows(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key``, ``field_name``, ``cell``: one row per field of each row, from one scan."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("cell")) for f in fields])
    return df.select(key, F.inline(pairs))
