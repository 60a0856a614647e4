"""The queries of this package by name, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut, table, texts
from . import address, consensus, mapping, mixing, neardup, packing, pii, quality, surrogates

Query = Callable[[SparkSession, str], DataFrame]
PII_FIELDS = ["job_description", "job_requirements", "job_benefits"]
TEXT_FIELDS = ["title", "job_description", "job_requirements"]
#: Setting of the session that holds the secret key; without it (tests) surrogates are drawn with a public one.
KEY_SETTING, PUBLIC_KEY = "spark.hirelode.surrogateKey", "not secret"


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return mapping.mapped_cells(texts(spark, d, "jobs"), table(spark, d, "city_ref"), table(spark, d, "education_ref"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("job_id", "field_name", "ref_id").distinct()


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values without an entry, with how often each stands there."""
    both = None
    for name, ref, text, known in ((mapping.LOCATION, "city_ref", "city", mapping.PLACES), (mapping.EDUCATION, "education_ref", "education_level", mapping.LEVELS)):
        cells = texts(spark, d, "jobs").select(F.col(name).alias("v"))
        none = mapping.map_values(cells, "v", table(spark, d, ref), "ref_id", text, known).where("ref_id = 0")
        part = cells.join(none, "v").groupBy("v").agg(F.count("*").alias("n_cells")).select(F.lit(name).alias("field_name"), F.col("v").alias("value_text"), "n_cells")
        both = part if both is None else both.unionByName(part)
    return both


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return consensus.annotation_labels(table(spark, d, "annotations")).unionByName(consensus.adjudicated_labels(table(spark, d, "adjudicated_cases")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_labels(spark, d))[0].where("posterior >= 0.5").select("table_name", "item_key")


def p3_items(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_labels(spark, d))[0].select("table_name", "item_key", F.round("posterior", 4).alias("posterior"), F.round("difficulty", 4).alias("difficulty"), "n_labels")


def p3_annotators(spark: SparkSession, d: str) -> DataFrame:
    return consensus.consensus(_labels(spark, d))[1].select("annotator", *[F.round(c, 4).alias(c) for c in ("skill", "reliability", "habit_shift")], "n_labels")


def p3_agreement(spark: SparkSession, d: str) -> DataFrame:
    return consensus.agreement(_labels(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.all_pairs(*neardup.near_duplicates(texts(spark, d, "jobs"), "job_id", TEXT_FIELDS))
    return pairs.select(F.col("a").alias("job_id_a"), F.col("b").alias("job_id_b"))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    linked = neardup.linked_members(*neardup.near_duplicates(texts(spark, d, "jobs"), "job_id", TEXT_FIELDS))
    return linked.select(F.col("id").alias("job_id"), "class_id", "n_links")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.findings(texts(spark, d, "jobs"), "job_id", PII_FIELDS).select("job_id", "field_name", "kind", "value_text")


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(texts(spark, d, "jobs"), "job_id", PII_FIELDS)


def p5_surrogates(spark: SparkSession, d: str) -> DataFrame:
    found = pii.findings(texts(spark, d, "jobs"), "job_id", PII_FIELDS)
    return surrogates.surrogates(cut(found), _key(spark)).select("kind", "canon", "value_text", "surrogate")


def p5_pseudonymised(spark: SparkSession, d: str) -> DataFrame:
    """The texts with surrogates in the place of personal data."""
    return surrogates.pseudonymised(texts(spark, d, "jobs"), "job_id", PII_FIELDS, _key(spark))


def _key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, PUBLIC_KEY)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.all_pairs(*address.same_houses(texts(spark, d, "geocode_cache"), "address_id", "company_address"))
    return pairs.select(F.col("a").alias("address_id_a"), F.col("b").alias("address_id_b"))


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    linked = neardup.linked_members(*address.same_houses(texts(spark, d, "geocode_cache"), "address_id", "company_address"))
    return linked.select(F.col("id").alias("address_id"), "class_id", "n_links")


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(texts(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "pack_sizes")
    return packing.fill_report(packing.packed(texts(spark, d, "documents"), sizes), sizes)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(texts(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(texts(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.outliers(texts(spark, d, "documents"), table(spark, d, "common_words")).select("doc_id")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    stats = quality.document_statistics(texts(spark, d, "documents"), table(spark, d, "common_words"))
    return stats.select("doc_id", "lang", "n_words", *[F.round(c, 6).alias(c) for c in quality.NAMES[1:-1]])


def p10_tails(spark: SparkSession, d: str) -> DataFrame:
    stats = quality.document_statistics(texts(spark, d, "documents"), table(spark, d, "common_words")).where("doc_id is not null")
    return quality.tail_scores(stats, "doc_id", "lang", quality.SIDES, "is_spoken")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p2_found, p2_unmatched, p3_found, p3_items, p3_annotators, p3_agreement, p4_found, p4_members, p5_found, p5_redacted, p5_surrogates, p5_pseudonymised,
        p6_found, p6_members, p8_packing, p8_fill, p9_mixture, p9_shares, p10_found, p10_statistics, p10_tails,
    )
}

ORACLE: dict[str, str] = {
    "p3_agreement": """
with a as (
  select 'annotations' as table_name, cv_id || '|' || job_id as item_key, annotator, skills_match as score, annotated_at, loaded_at
  from annotations where skills_match between 0 and 10 and annotator is not null and cv_id is not null and job_id is not null
), last_a as (
  select table_name, item_key, annotator, score from a
  qualify row_number() over (partition by item_key, annotator order by annotated_at desc nulls last, loaded_at desc nulls last, score desc) = 1
), c as (
  select pair_key, case_index, 'cohere' as annotator, original_model_scores.cohere.relevance_score as score from adjudicated_cases
  union all select pair_key, case_index, 'gptoss', original_model_scores.gptoss.relevance_score from adjudicated_cases
  union all select pair_key, case_index, 'llama', original_model_scores.llama.relevance_score from adjudicated_cases
), last_c as (
  select 'adjudicated_cases' as table_name, pair_key as item_key, annotator, score from c where score between 0 and 10 and pair_key is not null
  qualify row_number() over (partition by pair_key, annotator order by case_index desc nulls last, score desc) = 1
), l as (select * from last_a union all select * from last_c),
per as (
  select table_name, item_key, count(*)::double as n, sum(case when score >= 6 then 1 else 0 end)::double as k from l group by 1, 2 having count(*) > 1
), t as (
  select table_name, count(*) as n_items, avg((k * (k - 1) + (n - k) * (n - k - 1)) / (n * (n - 1))) as o, sum(k) / sum(n) as q from per group by 1
)
select table_name, n_items, round(o, 6) as observed, round(q * q + (1 - q) * (1 - q), 6) as expected,
       round((o - (q * q + (1 - q) * (1 - q))) / (1 - (q * q + (1 - q) * (1 - q))), 6) as kappa
from t
""",
}
