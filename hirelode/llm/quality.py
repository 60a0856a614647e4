"""Text quality statistics of documents and outlier scores over them.

Statistics are computed from whole texts.  Each is ranked exactly within its
language: the distinct values with their counts are range-partitioned and
sorted, each partition sums up its own counts, and partition offsets make the
sums global.  The ranks give empirical cumulative tail probabilities, whose
weighed negative logarithms add up to the score of a document; the score alone
tells which documents stand out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ACCENTED, BASE
from ..sources.tables import cut
from .ordered import running_sums

#: Statistic to the side whose tail is suspicious and the weight of its evidence.
SIDES: Mapping[str, tuple[str, float]] = {
    "loose_ratio": ("high", 6.0),
    "common_share": ("low", 0.25),
    "end_punct_share": ("low", 0.25),
    "words_per_line": ("low", 0.25),
    "symbol_ratio": ("high", 0.25),
    "digit_share": ("high", 0.25),
    "garbled_share": ("high", 0.25),
    "mean_word_length": ("high", 0.25),
}
#: A document with at least this score stands out.
CUT = 4.5
MOST_GARBLED, SENTENCE_WORDS = 0.08, 5
#: Values that bear more than this share of all ranked values, at most 1 / HOT of them, are sent to every task.
HOT = 1 / 20_000

_WORD = re.compile(r"[^\W_]+")
_ITEM = re.compile(r"(?m)^[ \t]*(?:[-*+•·▪●]|\d{1,3}[.)]|[A-Za-z]\))[ \t]+")
_TAG = re.compile(r"<[^>]*>")
_BLOCK = re.compile(r"\x01|\n[ \t]*\n")
_STOP = re.compile(r"(?<=[.!?…])(?:\s+|$)")
_ENDED = re.compile(r"[.!?…][\"'”’)\]]*\s*$")
_MARKS = re.compile(r"[|\t;»:=<>{}]")
_FOLD = str.maketrans(ACCENTED, BASE)
_GOOD = frozenset(ACCENTED + ACCENTED.upper())
#: Marks that UTF-8 read as a one-byte encoding leaves behind.
_BROKEN = frozenset("�¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿¡†‡ˆ‰Š‹ŒŽ€™œž") | frozenset(map(chr, range(0x80, 0xA0)))


def _latin_odd(c: str) -> bool:
    return c in _BROKEN or (0x7F < ord(c) < 0x250 and c.isalpha() and c not in _GOOD)


def text_statistics(text: str | None, common: Mapping[str, str]) -> tuple:
    """The statistics of one text and the language its common words speak for.

    A word is in a sentence if that has at least :data:`SENTENCE_WORDS` words up
    to a full stop and few of the marks of tables; a sentence goes across line
    breaks but not across items, tags or blank lines.  ``prose_share`` is the
    share of the words in sentences, ``loose_ratio`` the whole number of words
    outside for one inside; in a text whose letters are garbled no word is in a
    sentence.  An empty or null text has no words: its shares are 0, and it
    counts as one loose word.
    """
    t = unicodedata.normalize("NFC", text or "").replace("\r\n", "\n").replace("\r", "\n")
    words = _WORD.findall(t)
    n = len(words)
    hits: Counter[str] = Counter()
    digits = 0
    for w, k in Counter(words).items():
        if w.isdigit():
            digits += k
        elif lang := common.get(w.lower().translate(_FOLD)):
            hits[lang] += k
    lines = [x for x in t.split("\n") if x.strip()]
    ended = sum(bool(_ENDED.search(x)) for x in lines)
    letters = odd = symbols = 0
    for c, k in Counter(t).items():
        if c in _BROKEN or _latin_odd(c):
            odd += k
        if c.isalpha():
            letters += k
        elif not c.isspace() and not c.isdigit() and not unicodedata.combining(c):
            symbols += k
    share = lambda a, b: a / b if b else 0.0
    garbled = min(1.0, share(odd, letters or len(t)))
    prose = 0
    if garbled < MOST_GARBLED:
        for block in _BLOCK.split(_TAG.sub("\x01", _ITEM.sub("\x01", t))):
            for s in _STOP.split(block):
                if _ENDED.search(s):
                    k = len(_WORD.findall(s))
                    if k >= SENTENCE_WORDS and len(_MARKS.findall(s.strip())) <= 0.15 * k:
                        prose += k
    prose = min(prose, n)
    best = max(hits.values(), default=0)
    lang = max(hits, key=lambda x: (hits[x], x)) if best and best >= 0.05 * n else None
    return (
        n,
        share(sum(map(len, words)), n),
        share(symbols, len(t)),
        share(ended, len(lines)),
        share(best, n),
        share(digits, n),
        share(n, len(lines)),
        share(prose, n),
        garbled,
        float((n - prose) // max(prose, 1)) if n else 1.0,
        lang,
    )


NAMES = ["n_words", "mean_word_length", "symbol_ratio", "end_punct_share", "common_share", "digit_share", "words_per_line", "prose_share", "garbled_share", "loose_ratio", "spoken"]


def document_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id, lang, is_spoken`` and the statistics of each document.

    ``lang`` is the language of the text's common words (``is_spoken``), or else
    the first part of the column ``lang`` in lower case if the list has words of
    that language, or else ``und``.  The list of common words must be short
    (more than 100,000 raise ``ValueError``); a word of two languages counts for
    the first in order.  Null ids are kept as rows.
    """
    rows = common_words.where("word is not null and lang is not null").select("word", "lang").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the list of common words is beyond the size that is sent to every task")
    common: dict[str, str] = {}
    for w, lang in sorted((r["word"].lower().translate(_FOLD), r["lang"]) for r in rows):
        common.setdefault(w, lang)
    n_stats = len(NAMES) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [text_statistics(t, common) for t in batch.column("text").to_pylist()]
            cols = list(zip(*got)) if got else [()] * len(NAMES)
            arrays = [pa.array(cols[0], pa.int64())] + [pa.array(c, pa.float64()) for c in cols[1:n_stats]] + [pa.array(cols[n_stats], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *arrays], names=["doc_id", "stated", *NAMES])

    types = "doc_id bigint, stated string, n_words bigint, " + ", ".join(f"{n} double" for n in NAMES[1:n_stats]) + ", spoken string"
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, types)
    stated = F.regexp_extract(F.lower("stated"), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1)
    listed = F.when(stated.isin(sorted(set(common.values())) or [""]), stated)
    return d.select("doc_id", F.coalesce("spoken", listed, F.lit("und")).alias("lang"), F.col("spoken").isNotNull().alias("is_spoken"), *NAMES[:n_stats])


def tail_scores(stats: DataFrame, key: str, group: str, sides: Mapping[str, tuple[str, float]], known: str | None = None) -> DataFrame:
    """``key, group``, a tail probability ``<stat>_tail`` per statistic and ``score``, the weighed sum of their negative logarithms.

    A tail is the exact share of the group's rows with a value at least as far
    out; ties have the same rank, nulls count as 0.  Rows of the group ``und``
    are ranked among all rows, and so are those of a group in which the flag
    ``known`` holds for less than half of the rows: it can't tell what is usual.
    A row is one of the result, also where its key is null or stands twice.
    """
    names = list(sides)
    flag = F.col(known) if known else F.lit(True)
    rows = stats.select(key, group, flag.alias("_known"), F.monotonically_increasing_id().alias("_row"), *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in names])
    rows = cut(rows)
    trusted = rows.groupBy(group).agg((F.avg(F.col("_known").cast("double")) >= 0.5).alias("_ok"))
    groups = [r[0] for r in trusted.where(F.col("_ok") & F.col(group).isNotNull() & (F.col(group) != "und")).limit(10_001).collect()]
    if len(groups) > 10_000:
        raise ValueError("more groups than are sent to every task")
    own = F.when(F.col(group).isin(groups or [""]), F.col(group)).otherwise("*")
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(s).alias("v")) for i, s in enumerate(names)]))
    long = rows.select("_row", own.alias("_rank"), cells)
    both = long.select("stat", F.explode(F.array_distinct(F.array("_rank", F.lit("*")))).alias("_rank"), "v")
    sums = running_sums(both.groupBy("stat", "_rank", "v").count(), ["stat", "_rank"], ["v"], "count")
    high = F.col("stat").isin([i for i, s in enumerate(names) if sides[s][0] == "high"])
    tail = F.when(high, F.col("total") - F.col("before")).otherwise(F.col("before") + F.col("count")) / F.col("total")
    ranks = cut(sums.select("stat", "_rank", "v", "count", tail.alias("tail")))
    least = max(2, int(HOT * 2 * len(names) * rows.count()) + 1)
    frequent = F.col("count") >= least
    met = long.join(F.broadcast(ranks.where(frequent).drop("count")), ["stat", "_rank", "v"], "left")  # at most 1 / HOT rows
    rare = met.where("tail is null").drop("tail").join(ranks.where(~frequent).drop("count"), ["stat", "_rank", "v"])
    ranked = met.where("tail is not null").select("_row", "stat", "tail").unionByName(rare.select("_row", "stat", "tail"))
    each = ranked.groupBy("_row").agg(*[F.max(F.when(F.col("stat") == i, F.col("tail"))).alias(f"{s}_tail") for i, s in enumerate(names)])
    score = sum((F.lit(-sides[s][1]) * F.log(F.col(f"{s}_tail")) for s in names), F.lit(0.0))
    return rows.select("_row", key, group).join(each, "_row").select(key, group, *[f"{s}_tail" for s in names], F.round(score, 6).alias("score"))


def outliers(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id, score``: the documents whose score reaches :data:`CUT`; of a repeated id the greatest score.  Rows without an id are left out."""
    stats = document_statistics(documents, common_words).where("doc_id is not null")
    scores = tail_scores(stats, "doc_id", "lang", SIDES, "is_spoken").where(F.col("score") >= CUT)
    return scores.groupBy("doc_id").agg(F.max("score").alias("score"))
