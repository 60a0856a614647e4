"""Scores of pairs by a model: prompts, batches, retries, and what happens without one."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..config import CONFIG, MatchConfig
from ..functions import records
from ..functions.dialect import SPARK, column
from ..sources.tables import shipped

DIMENSIONS = ("relevance", "skills", "experience", "education", "salary")


class Scorer(Protocol):
    """Scores of one profile's adverts: a list as long as ``jobs``, each a mapping of :data:`DIMENSIONS`, or None for a row that has none."""

    def __call__(self, profile: str, jobs: Sequence[str]) -> Sequence[Mapping[str, object] | None]: ...


def job_prompt(j: Callable[[str], Column], position: Column) -> Column:
    """One advert as text for a model: requirements up to 800 letters, description up to 350."""
    part = lambda n: F.coalesce(j(n), F.lit(""))
    lines = [
        F.concat(F.lit("[JOB "), position.cast("string"), F.lit("] "), part("title")),
        F.concat(F.lit("Ngành: "), part("category"), F.lit(" | Lĩnh vực: "), part("company_field")),
        F.concat(F.lit("Lương: "), part("job_salary"), F.lit(" | Địa điểm: "), part("job_location"), F.lit(" | Kinh nghiệm: "), part("experience")),
        F.concat(F.lit("Học vấn: "), part("education_level")),
        F.concat(F.lit("Kỹ năng: "), part("technical_skills")),
        F.concat(F.lit("Mô tả: "), F.substring(part("job_description"), 1, 350)),
        F.concat(F.lit("Yêu cầu: "), F.substring(part("job_requirements"), 1, 800)),
    ]
    return F.concat_ws("\n", *lines)


def cv_prompt(c: Callable[[str], Column]) -> Column:
    """One profile as text for a model: codes by their labels, lines without content left out, the whole text up to 6000 letters."""
    line = lambda label, x: F.when(F.coalesce(F.trim(x), F.lit("")) != "", F.concat(F.lit(label), x))
    education = column(records.codes(SPARK, "education", records.EDUCATION_CODES))
    experience = column(records.codes(SPARK, "experience", records.EXPERIENCE_CODES))
    return F.concat_ws(
        "\n",
        line("Kỹ năng chuyên môn: ", c("skills")),
        line("Kỹ năng mềm: ", c("soft_skills")),
        line("Ngoại ngữ: ", c("languages")),
        line("Chứng chỉ: ", c("certificates")),
        line("Kinh nghiệm: ", experience),
        line("Học vấn: ", education),
        line("Địa điểm: ", c("cv_location")),
        line("", F.substring(F.trim(c("cv_markdown")), 1, 6000)),
    )


def scored_pairs(pairs: DataFrame, scorer: Scorer, parts: int = 4, tries: int = 3, cfg: MatchConfig = CONFIG) -> DataFrame:
    """``query, doc, place, relevance … salary, is_fallback, fallback_score``.

    ``pairs``: ``query, doc, place, profile, job``; the first ``cfg.scored``
    places of a profile, in ``parts`` even parts, are a model's batches.  A part
    that fails ``tries`` times, a reply that is too short, or a row without a
    score falls back to the score of its place; it doesn't touch other rows.  A
    missing or odd score is 5, others are cut to 0–10.
    """
    shipped(pairs.sparkSession)
    kinds = dict(pairs.dtypes)
    head = pairs.where(F.col("place") <= cfg.scored)
    n = F.count("*").over(W.partitionBy("query"))
    head = head.withColumn("_part", F.floor((F.row_number().over(W.partitionBy("query").orderBy("place")) - 1) * F.least(F.lit(parts), n) / n).cast("int"))

    def whole(x: object) -> int:
        try:
            return max(0, min(10, int(float(x))))  # type: ignore[arg-type]
        except (TypeError, ValueError, OverflowError):
            return 5

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("place")
        got: Sequence[Mapping[str, object] | None] = []
        for _ in range(tries):
            try:
                got = list(scorer(f["profile"].iloc[0], f["job"].tolist()))
                break
            except Exception:
                continue
        got = [got[i] if i < len(got) else None for i in range(len(f))]
        out = f[["query", "doc", "place"]].copy()
        for d in DIMENSIONS:
            out[d] = pd.array([None if g is None else whole(g.get(d)) for g in got], dtype="Int64")
        out["is_fallback"] = [g is None for g in got]
        return out

    types = f"query {kinds['query']}, doc {kinds['doc']}, place {kinds['place']}, " + ", ".join(f"{d} bigint" for d in DIMENSIONS) + ", is_fallback boolean"
    # a group is a part of one profile's first places: cfg.scored rows at most
    scored = head.groupBy("query", "_part").applyInPandas(lambda f: run(f), types)
    score = F.greatest(F.lit(cfg.tail_score), cfg.fallback_start - cfg.fallback_step * (F.col("place") - 1))
    return scored.withColumn("fallback_score", F.when(F.col("is_fallback"), F.round(score, 2)))


def with_location(scores: DataFrame, location: Column, weights: Column | None = None, cfg: MatchConfig = CONFIG) -> DataFrame:
    """``scores`` with the model's ``location`` replaced and ``total`` added up anew, by the profile's own weights (a map; missing ones are 0) or the usual ones."""
    d = scores.withColumn("location", location.cast("double"))
    dims = (*DIMENSIONS, "location")
    weight = lambda k: F.coalesce(weights[k], F.when(weights.isNull(), F.lit(cfg.weights[k])).otherwise(F.lit(0.0))) if weights is not None else F.lit(cfg.weights[k])
    return d.withColumn("total", F.round(sum((F.col(k).cast("double") * weight(k) for k in dims), F.lit(0.0)), 2))


def attached(jobs: DataFrame, scores: DataFrame, missing: float = 5.0) -> DataFrame:
    """``jobs`` (``query, doc, place``) with the score of the same place; places beyond a short list get ``missing``."""
    return jobs.join(scores.select("query", "place", "score"), ["query", "place"], "left").withColumn("score", F.coalesce("score", F.lit(missing)))


#: Sections of a profile's text by their headings.
PROFILE_FIELDS = ("technical_skills", "soft_skills", "languages", "certificates", "experience", "education", "location")


def parsed_profiles(texts: DataFrame, key: str, text: str, parsers: Sequence[Callable[[str], Mapping[str, str] | None]], least: int = 50) -> DataFrame:
    """``key, success, error`` (``short``, ``unparsed`` or null), the fields, ``raw_text``: each text through the first parser that can.

    A text under ``least`` letters, or one that no parser takes, is a record of
    failure with empty fields; its text is kept up to 500 and 1000 letters, that
    of others up to 8000.
    """
    shipped(texts.sparkSession)

    def one(t: str | None) -> tuple:
        t = t or ""
        if len(t.strip()) < least:
            return (False, "short", *[""] * len(PROFILE_FIELDS), t[:500])
        for p in parsers:
            try:
                got = p(t)
            except Exception:
                got = None
            if got:
                return (True, None, *[str(got.get(f) or "") for f in PROFILE_FIELDS], t[:8000])
        return (False, "unparsed", *[""] * len(PROFILE_FIELDS), t[:1000])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["success", "error", *PROFILE_FIELDS, "raw_text"]
        for f in frames:
            rows = pd.DataFrame([one(t) for t in f["t"]], columns=names, dtype=object)
            yield rows.assign(**{key: f[key].to_numpy()})[[key, *names]]

    kind = dict(texts.dtypes)[key]
    types = f"`{key}` {kind}, success boolean, error string, " + ", ".join(f"{f} string" for f in PROFILE_FIELDS) + ", raw_text string"
    return texts.select(key, F.col(text).cast("string").alias("t")).mapInPandas(run, types)


def heading_parser(headings: Mapping[str, str]) -> Callable[[str], Mapping[str, str] | None]:
    """A parser of texts in sections ``## heading``: ``headings`` gives the field of each; None for a text without any of them."""
    import re

    def parse(text: str) -> Mapping[str, str] | None:
        found = {}
        for m in re.finditer(r"(?ms)^##+\s*(.+?)\s*$\n(.*?)(?=^##|\Z)", text):
            field = headings.get(m.group(1).strip().lower())
            if field:
                found[field] = m.group(2).strip()
        return found or None

    return parse
