import random

from hirelode.llm.consensus import adjudicated_labels, agreement, annotation_labels, consensus

KIND = "cv_id string, job_id string, annotator string, skills_match int, annotated_at timestamp, loaded_at timestamp, score int, at string"


def test_last_valid_score_counts(spark):
    from datetime import datetime as D

    rows = [("c", "j", "a", 3, D(2026, 1, 1), D(2026, 1, 1), 0, ""), ("c", "j", "a", 8, D(2026, 1, 2), None, 0, ""), ("c", "j", "a", 8, D(2026, 1, 2), None, 0, ""), ("c", "j", "b", 11, None, None, 0, ""), ("c", "j", None, 5, None, None, 0, ""), (None, "j", "a", 5, None, None, 0, ""), ("c", "j", "b", None, None, None, 0, "")]
    got = annotation_labels(spark.createDataFrame(rows, KIND)).collect()
    assert [(r.item_key, r.annotator, r.score) for r in got] == [("c|j", "a", 8)]


def test_habits_and_reliability(spark):
    rnd = random.Random(5)
    rows, truth = [], {}
    for i in range(600):
        key = f"i{i}"
        high = truth[key] = rnd.random() < 0.45
        base = rnd.choice([7, 8, 9]) if high else rnd.choice([1, 2, 3])
        said = {"good": base, "good2": min(10, max(0, base + rnd.choice([-1, 0, 1]))), "harsh": max(0, base - 3), "kind": min(10, base + 3), "flat": rnd.choice([7, 8]), "random": rnd.randint(0, 10), "inverted": 10 - base}
        rows += [("t", key, a, s) for a, s in said.items() if rnd.random() < 0.6 or a == "flat"]
    items, people = consensus(spark.createDataFrame(rows, "table_name string, item_key string, annotator string, score int"))
    got = {r.item_key: r.posterior >= 0.5 for r in items.collect()}
    right = sum(got[k] == truth[k] for k in got) / len(got)
    rel = {r.annotator: r.reliability for r in people.collect()}
    assert right > 0.96 and min(rel["good"], rel["harsh"], rel["kind"]) > 0.7 and max(rel["flat"], rel["random"]) < 0.3


def test_empty_and_agreement(spark):
    kind = "table_name string, item_key string, annotator string, score int"
    items, people = consensus(spark.createDataFrame([], kind))
    assert items.count() == 0 and people.count() == 0 and agreement(spark.createDataFrame([], kind)).count() == 0
    one = agreement(spark.createDataFrame([("t", "a", "x", 9), ("t", "a", "y", 9), ("t", "b", "x", 9)], kind)).collect()[0]
    assert (one.n_items, one.observed, one.kappa) == (1, 1.0, None)


def test_adjudicated(spark):
    s = "struct<relevance_score:int,skills_match:int>"
    df = spark.createDataFrame([(1, "k", ((5, 1), (None, 1), (9, 1))), (2, "k", ((6, 1), None, (9, 1))), (3, None, None)], f"case_index bigint, pair_key string, original_model_scores struct<cohere:{s},gptoss:{s},llama:{s}>")
    assert sorted((r.annotator, r.score) for r in adjudicated_labels(df).collect()) == [("cohere", 6), ("llama", 9)]


def test_too_many_annotators_are_refused_before_they_are_collected(spark, monkeypatch):
    import pytest

    from hirelode.llm import consensus as module

    monkeypatch.setattr(module, "MAX_ANNOTATORS", 3)
    df = spark.createDataFrame([("t", "k", f"a{i}", 5) for i in range(4)], "table_name string, item_key string, annotator string, score int")
    with pytest.raises(ValueError):
        consensus(df)
