import random
import re
from collections import Counter

import numpy as np

from hirelode.llm.neardup import FULL, GROUPS, _packed, _unpacked, all_pairs, linked_members, near_duplicates, tree_pairs

COLS = ["title", "job_description", "job_requirements"]


def brute(rows, share=0.8):
    bags = {r[0]: Counter(re.findall(r"[^\W_]+", " ".join(x for x in r[1:] if x).lower())) for r in rows}
    size = {k: sum(b.values()) for k, b in bags.items()}
    ids = sorted(k for k in bags if size[k])
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sum((bags[a] & bags[b]).values()) >= share * max(size[a], size[b]) - 1e-9}


def test_recall_and_precision_on_the_table(spark, data):
    jobs = spark.read.parquet(f"{data}/../sf0.01/jobs.parquet")
    members, pairs = near_duplicates(jobs, "job_id", COLS)
    got = {tuple(r) for r in all_pairs(members, pairs).collect()}
    want = brute([tuple(r) for r in jobs.select("job_id", *COLS).collect()])
    assert not got - want and len(got & want) >= 0.99 * len(want) and want
    links = {r.id: r.n_links for r in linked_members(members, pairs).collect()}
    assert links == {i: sum(i in p for p in got) for i in links}


def test_recall_at_the_threshold(spark):
    rows = []
    for i in range(200):
        both = " ".join(f"p{i}w{k}" for k in range(80))
        rows += [(2 * i + side, both, " ".join(f"p{i}s{side}w{k}" for k in range(20)), None) for side in (0, 1)]
    members, pairs = near_duplicates(spark.createDataFrame(rows, "job_id bigint, title string, job_description string, job_requirements string"), "job_id", COLS)
    assert {(r.a, r.b) for r in pairs.collect()} == {(2 * i, 2 * i + 1) for i in range(200)}


def test_edges(spark):
    kind = "job_id bigint, title string, job_description string, job_requirements string, id string, toks int"
    long = " ".join(f"từ{i % 700}" for i in range(60000))
    rows = [(1, "Alpha beta", None, ""), (2, "beta ALPHA", "", None), (3, None, None, None), (4, "...", "", ""), (None, "alpha beta", "", ""), (5, long, "", ""), (6, long + " x", "", ""), (7, "solo", "", ""), (8, "beta alpha", None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], kind)
    members, pairs = near_duplicates(df, "job_id", COLS)
    assert {tuple(r) for r in all_pairs(members, pairs).collect()} == {(1, 2), (1, 8), (2, 8), (5, 6)}
    assert {r.id: (r.class_id, r.n_links) for r in linked_members(members, pairs).collect()} == {1: (1, 2), 2: (1, 2), 8: (1, 2), 5: (5, 1), 6: (6, 1), 7: (7, 0)}
    members, pairs = near_duplicates(df.limit(0), "job_id", COLS)
    assert members.count() == 0 and pairs.count() == 0


def test_a_third_are_copies(spark):
    rnd = random.Random(3)
    text = lambda: " ".join(f"w{rnd.randint(0, 4000)}" for _ in range(60))
    copy = text()
    rows = [(i, copy if i % 3 == 0 else text(), None, None) for i in range(600)]
    members, pairs = near_duplicates(spark.createDataFrame(rows, "job_id bigint, title string, job_description string, job_requirements string"), "job_id", COLS)
    assert pairs.count() == 0 and members.where("class_id = 0").count() == 200


def test_tree_loses_nothing():
    rng = np.random.default_rng(1)
    base = rng.poisson(0.6, (60, GROUPS))
    vec = np.minimum(np.concatenate([base, np.maximum(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1), 0)] * 2), FULL).astype(np.uint8)
    vec[5, :2] = FULL
    n = vec.sum(1, dtype=np.int64)
    i, j = tree_pairs(vec, n, 0.8)
    low = np.minimum(vec[:, None], vec[None]).sum(-1, dtype=int)
    want = {(a, b) for a in range(len(vec)) for b in range(a) if low[a, b] >= 0.8 * max(n[a], n[b])}
    assert want <= {(max(x, y), min(x, y)) for x, y in zip(i.tolist(), j.tolist())}


def test_hot_tiles_and_classes_go_in_blocks(spark, monkeypatch):
    """Sizes beyond the bounds, also where the list of hot ones is too long to be sent."""
    from hirelode.llm import neardup

    rows = [(i, "alpha beta gamma delta " * 5 + f"w{i % 40}", None, None) for i in range(120)]
    df = spark.createDataFrame(rows, "job_id bigint, title string, job_description string, job_requirements string")
    want = brute(rows)
    assert len(want) == 120 * 119 // 2
    monkeypatch.setattr(neardup, "RARE", 2)  # all words weigh alike: here each is in most of the texts
    for sent in (50_000, 0):
        monkeypatch.setattr(neardup, "HOT", 7 if sent else 2)
        monkeypatch.setattr(neardup, "SENT", sent)
        assert {tuple(r) for r in all_pairs(*near_duplicates(df, "job_id", COLS)).collect()} == want


def test_a_tile_that_goes_on_in_the_next_batch():
    import pyarrow as pa

    from hirelode.llm.neardup import _met

    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["tile", "id"])
    got = [tuple(r.values()) for b in _met(iter([batch((1, 1), (2, 2)), batch((2, 3)), batch((2, 4), (3, 5)), batch(), batch((4, 6), (4, 7))])) for r in b.to_pylist()]
    assert got == [(2, 2), (2, 3), (2, 4), (4, 6), (4, 7)] and list(_met(iter([]))) == []


def test_packed_counts():
    counts = np.random.default_rng(2).integers(0, 40, (7, GROUPS))
    assert (_unpacked(_packed(counts)) == np.minimum(counts, FULL)).all()
