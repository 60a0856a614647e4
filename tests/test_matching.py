from datetime import date

from pyspark.sql import functions as F

from hirelode.config import CONFIG
from hirelode.operators import diversity, expansion, ingest, matching, retrieval
from hirelode.plans import matching as plans
from hirelode.streaming.upsert import stream_upsert


def ranks(spark, items):
    return spark.createDataFrame([("q", ord(x), i) for i, x in enumerate(items, 1)], "query string, doc bigint, rank int")


def test_fusion(spark):
    got = {chr(r.doc): r for r in retrieval.fuse(ranks(spark, "ABC"), ranks(spark, "BD"), 10).collect()}
    assert {k: round(v.rrf_score, 6) for k, v in got.items()} == {"B": 0.032522, "A": 0.016393, "D": 0.016129, "C": 0.015873}
    back = {chr(r.doc): r.rrf_score for r in retrieval.fuse(ranks(spark, "BD"), ranks(spark, "ABC"), 10).collect()}
    assert back == {k: v.rrf_score for k, v in got.items()} and max(back.values()) <= 2 / (CONFIG.rrf_k + 1)


def test_fallback_and_weights(spark):
    got = [r[0] for r in spark.range(18).select(F.expr(matching.fallback("id"))).collect()]
    assert [got[i] for i in (0, 1, 5, 16, 17)] == [5.0, 4.88, 4.4, 3.08, 3.0]
    sql = matching.weighted({"relevance": "8", "skills": "8", "experience": "7", "education": "9", "location": "8.5", "salary": "7"})
    assert spark.range(1).select(F.expr(sql)).collect()[0][0] == 7.9


def test_nearest_is_exact_and_guarded(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0], i % 2) for i in range(40)] + [(100, None, 0), (101, [0.0, 0.0, 0.0], 0)]
    v = spark.createDataFrame(rows, "id bigint, vec array<double>, tag int")
    got = retrieval.nearest(v.where("id = 3"), v, 5).collect()
    assert len(got) == 5 and {r.doc for r in got} <= {i for i, *_ in rows} - {3, 100} and got[0].score <= 1.0000001
    assert retrieval.nearest(v.where("id < 0"), v, 5).count() == 0
    assert all(r.doc % 2 == 1 for r in retrieval.nearest(v.where("id = 3"), v.where("id < 100"), 5, same_tag=True).collect())


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "Java java SQL", None), (2, None, "x"), (3, "", "y"), (4, "sql " * 3000, "z")], "id bigint, t string, doc string")
    q = spark.createDataFrame([("a", "java SQL"), ("b", None), ("c", "")], "k string, txt string")
    index = retrieval.built_index(docs, "id", ["t"])
    got = retrieval.search(index, retrieval.query_terms(q, "k", "txt"), {"t": 1.0, "missing": 9.0}, 0.2, 10).collect()
    assert [(r.query, r.doc) for r in sorted(got, key=lambda r: r.rank)] == [("a", 1), ("a", 4)]


def test_relaxed_keeps_profiles_without_hits(spark):
    cv = spark.createDataFrame([("a",), ("b",)], "k string")
    strict = spark.createDataFrame([("a", i, i) for i in range(CONFIG.relax_below)], "query string, doc bigint, rank int")
    loose = spark.createDataFrame([("a", 99, 1), ("b", 98, 1)], "query string, doc bigint, rank int")
    few = retrieval.short_lists(strict, cv, "k")
    got = retrieval.relaxed(strict, loose, few).collect()
    assert {(r.query, r.is_relaxed) for r in got} == {("a", False), ("b", True)}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("u1", "h1", 0), ("u2", "h2", 0), ("u4", None, 0)], "url string, digest string, seen int")
    new = spark.createDataFrame([("u1", "h1"), ("u2", "h3"), ("u3", "h4"), (None, "h5"), ("u4", None)], "url string, digest string")
    acts = {r.url: r.action for r in ingest.upsert_actions(old, new, "url", "digest").collect()}
    assert acts == {"u1": "touch", "u2": "update", "u3": "insert", "u4": "touch"}
    once = ingest.merged(old, new, "url", "digest", "seen", F.lit(1))
    twice = ingest.merged(once, new, "url", "digest", "seen", F.lit(1))
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    assert {tuple(r) for r in once.collect()} == {("u1", "h1", 1), ("u2", "h3", 1), ("u3", "h4", 1), ("u4", None, 1)}


def test_precheck_quota_interleave(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("c",), ("",), (None,), ("a",)], "url string")
    known = spark.createDataFrame([("b", date(2026, 1, 1)), ("c", date(2026, 2, 27))], "url string, seen_at date")
    status = lambda n: {r.url: r.status for r in ingest.precheck(urls, known, F.lit("2026-03-01").cast("date"), n).collect()}
    assert status(7) == {"a": "new", "b": "recrawl", "c": "skip"} and status(-1) == {"a": "new", "b": "skip", "c": "skip"}
    new = spark.createDataFrame([("g", i) for i in range(5)], "g string, i int")
    assert ingest.quota_fill(new, new.limit(2), ["g"], ["i"], 4).count() == 2
    lists = spark.createDataFrame([("g", 1, 1, "x"), ("g", 1, 2, "y"), ("g", 2, 1, "y"), ("g", 2, 2, "z")], "g string, lvl int, i int, item string")
    assert [r.item for r in ingest.interleaved(lists, "g", "lvl", ["i"], "item").orderBy("place").collect()] == ["x", "y", "z"]


def test_expansion(spark):
    cv = spark.createDataFrame([(1, ["Python", " python ", "Excel"]), (2, []), (3, None)], "k int, s array<string>")
    labels = spark.createDataFrame([("python", i, a) for i, a in enumerate("abcd", 1)], "label string, alt_no int, alt string")
    got = expansion.expand_exact(expansion.term_rows(cv, "k", F.col("s")), "k", labels).orderBy("place").collect()
    assert [r.term for r in got] == ["Python", "Excel", "a", "b", "c"]


def test_diversity(spark):
    df = spark.createDataFrame([("g", 1, ["a", "b"]), ("g", 2, ["a", "b", "c"]), ("g", 3, ["x", "y"]), (None, 4, ["q"])], "g string, k bigint, w array<string>")
    assert [r.k for r in diversity.diverse(df, "g", "k", "w", 2).orderBy("place").collect()] == [1, 3]


def test_diversity_among_all_records(spark):
    rows = [("g", i, ["a", "b", f"w{i}"]) for i in range(2, 2005)] + [("g", 1, ["a"]), ("g", 3000, ["z"]), ("h", 7, []), ("h", 8, []), ("h", 9, ["q"])]
    got = diversity.diverse(spark.createDataFrame(rows, "g string, k bigint, w array<string>"), "g", "k", "w", 4).orderBy("g", "place").collect()
    assert [(r.g, r.k, r.place) for r in got] == [("g", 1, 1), ("g", 3000, 2), ("g", 2, 3), ("g", 3, 4), ("h", 7, 1), ("h", 9, 2), ("h", 8, 3)]


def _file(spark, path, rows):
    spark.createDataFrame(rows, "url string, digest string, at int").coalesce(1).write.mode("append").parquet(str(path))


def test_stream(spark, tmp_path):
    for rows in ([("u1", "h1", 1), ("u2", "h2", 1)], [("u1", "h9", 2), (None, "x", 2), ("u1", "h9", 2)]):
        _file(spark, tmp_path / "in", rows)
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    got = stream_upsert(spark, str(tmp_path / "in"), schema, "url", "digest", ["at"], files_per_batch=1)
    assert {(r.url, r.digest) for r in got.collect()} == {("u1", "h9"), ("u2", "h2")}


def test_stream_is_killed_and_resumed(spark, tmp_path, monkeypatch):
    """Cut short between the data and the manifest, taken up again, then again with new files: nothing lost, nothing twice."""
    from hirelode.streaming import upsert

    source, path = tmp_path / "in", str(tmp_path / "out")
    _file(spark, source, [(f"u{i}", "h1", 1) for i in range(40)])
    schema = spark.read.parquet(str(source)).schema
    run = lambda: stream_upsert(spark, str(source), schema, "url", "digest", ["at"], files_per_batch=1, path=path, buckets=8)
    whole = upsert.KeyedTable._commit
    monkeypatch.setattr(upsert.KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    try:
        run()
        raise AssertionError("not killed")
    except Exception as e:
        assert "killed" in str(e)
    table = upsert.KeyedTable(spark, f"{path}/table", "url", schema, 8)
    assert table.committed() == [] and table.read().count() == 0
    monkeypatch.setattr(upsert.KeyedTable, "_commit", whole)
    assert {(r.url, r.digest, r.seen_batch) for r in run().collect()} == {(f"u{i}", "h1", 0) for i in range(40)}
    before = table.manifest()
    _file(spark, source, [("u3", "h2", 2), (None, "x", 2)])
    got = {r.url: (r.digest, r.seen_batch) for r in run().collect()}
    assert len(got) == 40 and got["u3"] == ("h2", 1) and got["u4"] == ("h1", 0)
    after = table.manifest()
    assert sum(after[b] != before[b] for b in before) == 1  # only the touched bucket was rewritten
    assert {(r.url, r.digest, r.seen_batch) for r in run().collect()} == {(u, *v) for u, v in got.items()}  # no new file, no change
    state = upsert.KeyedTable(spark, f"{path}/table", "url", run().schema, 8)
    state.write(1, spark.createDataFrame([("u3", "other")], "url string, digest string"), "digest", "seen_batch")  # a replayed batch
    assert {r.url: r.digest for r in run().collect()}["u3"] == "h2"


def test_hash_index_recall(spark, data):
    """Against the exact search."""
    v = spark.read.parquet(f"{data}/../sf0.01/embeddings.parquet")
    every = v.selectExpr("vec_id as id", "embedding as vec", "0 as tag")
    exact = {(r.query, r.doc) for r in retrieval.nearest(every.where("id % 25 = 0"), every, 10).collect()}
    found = {(r.query, r.doc) for r in retrieval.nearest_by_hash(v.where("vec_id % 25 = 0"), v, "vec_id", "embedding", 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_core_plans_have_no_python(spark, data):
    for name in ("bm25_topk", "same_city_partition", "browse_search"):
        plan = plans.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "MapInPandas" not in plan and "CartesianProduct" not in plan, name
