import math

from hirelode.llm.ordered import running_sums
from hirelode.llm.quality import NAMES, SIDES, document_statistics, outliers, tail_scores, text_statistics
from hirelode.sources.tables import table

COMMON = {"va": "vi", "la": "vi", "cho": "vi", "the": "en", "and": "en"}
PROSE = "Chị trưởng nhóm thường dặn rằng phải biết cẩn thận với con số và giữ lời hứa cho khách. Công việc là lặp lại mỗi tuần nhưng luôn có điều mới."


def stat(text):
    return dict(zip(NAMES, text_statistics(text, COMMON)))


def test_statistics():
    s = stat(PROSE)
    assert s["prose_share"] == 1.0 and s["loose_ratio"] == 0.0 and s["garbled_share"] == 0.0 and s["end_punct_share"] == 1.0 and s["spoken"] == "vi"
    assert stat("• " + PROSE.replace(". ", ".\n• "))["prose_share"] == 1.0
    assert stat("1. Docker\n2. Khai báo thuế\n3. Tiếng Nhật N3")["loose_ratio"] == 10.0
    assert stat(PROSE.encode().decode("latin-1"))["garbled_share"] > 0.2 and stat(PROSE.encode().decode("latin-1"))["prose_share"] == 0.0
    assert stat("| a | b |\n| c | d |")["prose_share"] == 0.0 and stat('<div class="x"><a href="/y"></a></div>')["prose_share"] == 0.0
    assert stat(None)["n_words"] == 0 and stat("")["symbol_ratio"] == 0.0 and stat("")["loose_ratio"] == 1.0
    assert stat("x " * 200000)["n_words"] == 200000 and stat("x " * 200000)["words_per_line"] == 200000.0


def _brute(rows, names, ranked_by):
    for me in rows:
        group = [x for x in rows if ranked_by(me) is None or ranked_by(x) == ranked_by(me)]
        yield me, [sum((x[i] <= me[i]) if side == "low" else (x[i] >= me[i]) for x in group) / len(group) for i, side in names]


def test_tails_are_exact(spark):
    rows = [(i, "vi" if i % 2 else "und", (i * 7 % 11) / 7, 1e9 + i % 5) for i in range(200)] + [(900, "vi", None, 3.0), (5, "vi", 0.5, 7e12)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, a double, b double")
    got = tail_scores(df, "doc_id", "lang", {"a": ("low", 1.0), "b": ("high", 2.0)}).collect()
    want = [(me[0], me[1], *t) for me, t in _brute([(k, g, a or 0.0, b) for k, g, a, b in rows], [(2, "low"), (3, "high")], lambda x: None if x[1] == "und" else x[1])]
    near = lambda rs: sorted((k, g, round(a, 9), round(b, 9)) for k, g, a, b in rs)
    assert near([(r.doc_id, r.lang, r.a_tail, r.b_tail) for r in got]) == near(want)
    assert all(abs(r.score + math.log(r.a_tail) + 2 * math.log(r.b_tail)) < 1e-5 for r in got)


def test_ranks_of_a_whole_table(spark, data):
    """Unclipped values, against brute force."""
    stats = document_statistics(table(spark, data, "documents"), table(spark, data, "common_words"))
    stats = stats.where("doc_id is not null").cache()
    rows = [(r.doc_id, r.lang, r.words_per_line, r.mean_word_length) for r in stats.collect()]
    assert max(r[2] for r in rows) > 100
    got = {r.doc_id: (r.words_per_line_tail, r.mean_word_length_tail) for r in tail_scores(stats, "doc_id", "lang", SIDES, "is_spoken").collect()}
    assert len(got) == len(rows)
    spoken = {g: [r.is_spoken for r in stats.where(f"lang = '{g}'").collect()] for g in {r[1] for r in rows}}
    own = lambda x: x[1] if x[1] != "und" and 2 * sum(spoken[x[1]]) >= len(spoken[x[1]]) else None
    for me, want in _brute(rows, [(2, "low"), (3, "high")], own):
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[me[0]], want))


def test_a_tag_borne_by_junk_alone_is_ranked_among_all(spark):
    words = spark.createDataFrame([("và", "vi"), ("the", "en")], "word string, lang string")
    docs = [(i, PROSE + f" Số {i} là ví dụ cho bạn và tôi.", "vi") for i in range(60)] + [(100 + i, f"A{i}\nB\nC", "en") for i in range(8)]
    got = outliers(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), words)
    assert {r.doc_id for r in got.collect()} == {100 + i for i in range(8)}


def test_running_sums(spark):
    rows = [(g, i, i % 4) for g in "ab" for i in range(300)]
    got = {(r.g, r.i): (r.before, r.total) for r in running_sums(spark.createDataFrame(rows, "g string, i int, v bigint"), ["g"], ["i"], "v").collect()}
    assert all(got[g, i] == (sum(k % 4 for k in range(i)), 450) for g, i, _ in rows)


def test_outliers(spark):
    words = spark.createDataFrame([("và", "vi"), ("cho", "vi"), (None, "vi"), ("the", "en")], "word string, lang string")
    docs = [(i, PROSE + f" Số {i} là ví dụ cho bạn.", "vi") for i in range(30)] + [(100, "A\nB\nC", None), (101, "", "VI-vn"), (102, None, "???"), (None, "x", "vi"), (103, "• Word\n• Excel", "vi"), (103, "• Word\n• Excel", "vi")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").selectExpr("*", "1 as n_words", "'q' as spoken", "0 as stat", "0 as tail")
    assert sorted(r.doc_id for r in outliers(df, words).collect()) == [100, 101, 102, 103]
    assert outliers(df.limit(0), words).count() == 0
    assert {r.lang for r in document_statistics(df, words).collect()} == {"vi", "und"}
