"""Skill taxonomies: crosswalks, titles and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import evaluated

#: What a title may bear behind it in the taxonomy, the preferred first.
SUFFIXES = ("(computer programming)", "(software)")


def crosswalk_tools(occupations: DataFrame, crosswalk: DataFrame, tools: DataFrame) -> DataFrame:
    """``uri, code, tool``: tools of occupations over the code that the crosswalk gives their title.

    ``occupations``: ``uri, title``; ``crosswalk``: ``row_no, title, code``, of a
    title's rows the last counts; ``tools``: ``code, tool``.  Titles agree but
    for case and blanks around; blank titles, codes and tools don't count.
    """
    key = lambda c: F.lower(F.trim(F.col(c)))
    rows = crosswalk.select("row_no", key("title").alias("t"), F.trim("code").alias("code")).where("t <> '' and code <> ''")
    last = rows.groupBy("t").agg(F.max_by("code", F.struct("row_no", "code")).alias("code"))
    known = tools.select(F.trim("code").alias("code"), F.trim("tool").alias("tool")).where("code <> '' and tool <> ''").distinct()
    return occupations.select("uri", F.lower("title").alias("t")).join(last, "t").join(known, "code").select("uri", "code", "tool").distinct()


def resolved_titles(titles: DataFrame, nodes: DataFrame) -> DataFrame:
    """``title, uri, type``: the node each title means, null if none.

    A title with one of :data:`SUFFIXES` goes first, in their order, then the
    title itself; of nodes of one title a tool gives way to others, then the
    least ``uri`` counts.  Case and blanks around don't matter.
    """
    named = nodes.select(F.lower(F.trim("title")).alias("form"), "uri", "type").where("form <> ''")
    one = named.groupBy("form").agg(F.min(F.struct((F.col("type") == "TOOL").alias("is_tool"), "uri", "type")).alias("n"))
    asked = titles.select("title", F.lower(F.trim("title")).alias("t")).where("t <> ''").distinct()
    forms = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat_ws(" ", "t", F.lit(s)).alias("form")) for i, s in enumerate(SUFFIXES)], F.struct(F.lit(len(SUFFIXES)).alias("rank"), F.col("t").alias("form")))
    met = asked.select("title", F.inline(forms)).join(one, "form").groupBy("title").agg(F.min_by("n", "rank").alias("n"))
    return asked.select("title").join(met, "title", "left").select("title", F.col("n.uri").alias("uri"), F.col("n.type").alias("type"))


def _first_label(d: DataFrame, text: str) -> DataFrame:
    """``d`` with ``preferred``: the words of ``text`` before one comes again; four, if six come without; all of up to three words."""
    d = evaluated(d, {"_w": F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")})
    d = evaluated(d, {"_f": F.transform("_w", lambda w: F.regexp_replace(F.lower(w), r"^[.,;:]+|[.,;:]+$", ""))})
    # the place, from 1, of the first of the first six words that was there before
    early = F.filter(F.sequence(F.lit(2), F.greatest(F.least(F.size("_f"), F.lit(6)), F.lit(2))), lambda i: F.array_position("_f", F.get("_f", i - 1)) < i)
    d = evaluated(d, {"_again": F.get(early, F.lit(0)), "_n": F.size("_w")})
    take = F.when(F.col("_again").isNotNull(), F.col("_again") - 1).when(F.col("_n") >= 6, F.lit(4)).otherwise(F.col("_n"))
    first = F.when(F.col("_n") <= 3, F.trim(text)).otherwise(F.array_join(F.slice("_w", F.lit(1), F.greatest(take, F.lit(0))), " "))
    return d.withColumn("preferred", first).drop("_w", "_f", "_again", "_n")


def split_descriptions(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, preferred, labels, description`` of texts that run labels and sentences together.

    The description begins with the first sentence of over 40 letters that has a
    capital first and a full stop, or over 80 letters; else it is the last
    sentence.  A text of one sentence is all labels, and its own description;
    null is empty.
    """
    d = df.select(key, F.trim(F.coalesce(text, F.lit(""))).alias("_t"))
    d = evaluated(d, {"_p": F.split("_t", r"(?<=[.!?])\s+")})
    long = lambda s: (F.length(s) > 40) & s.rlike(r"^\p{Lu}") & (s.contains(".") | (F.length(s) > 80))
    d = evaluated(d, {"_n": F.size("_p"), "_at": F.coalesce(F.get(F.filter(F.sequence(F.lit(1), F.size("_p")), lambda i: long(F.trim(F.get("_p", i - 1)))), F.lit(0)), F.size("_p"))})
    joined = lambda a, k: F.array_join(F.slice("_p", a, k), ". ")
    one, at, n = F.col("_n") <= 1, F.col("_at"), F.col("_n")
    labels = F.when(~one & (at > 1), joined(F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise("")
    d = evaluated(d, {"labels": labels, "description": F.when(one, F.col("_t")).otherwise(joined(at, n - at + 1))})
    d = d.withColumn("_source", F.when(F.col("_n") <= 1, F.col("_t")).otherwise(F.col("labels")))
    return _first_label(d, "_source").select(key, "preferred", "labels", "description")


def concept_fields(reply: Column) -> dict[str, Column]:
    """The fields of a concept's JSON: title, other labels (a list or one text) joined by `` | ``, first type's title, description."""
    get = lambda path: F.get_json_object(reply, path)
    alt = get("$.alternativeLabel.en")
    listed = F.array_join(F.from_json(alt, "array<string>"), " | ")
    return {
        "preferred_label": F.coalesce(get("$.title"), F.lit("")),
        "alt_labels": F.coalesce(F.when(F.ltrim(alt).startswith("["), listed).otherwise(alt), F.lit("")),
        "skill_type": F.coalesce(get("$._links.hasSkillType[0].title"), F.lit("")),
        "description_en": F.coalesce(get("$.description.en.literal"), F.lit("")),
    }


def uri_tail(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def page_fields(page: Column) -> dict[str, Column]:
    """Title, first heading, described content, links and text of a page, by patterns; what is missing is empty."""
    text = F.coalesce(page, F.lit(""))
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))
    first = lambda p: bare(F.regexp_extract(text, p, 1))
    return {
        "page_title": first(r"(?is)<title[^>]*>(.*?)</title>"),
        "heading": F.coalesce(F.nullif(first(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit("")), first(r"(?is)<h2[^>]*>(.*?)</h2>")),
        "described": first(r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']"""),
        "n_links": F.size(F.regexp_extract_all(text, F.lit(r"(?i)<a\s[^>]*href="), F.lit(0))),
        "bare_text": bare(text),
    }
