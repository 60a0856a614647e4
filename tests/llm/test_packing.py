import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hirelode.llm import mixing
from hirelode.llm.mixing import mixture, plan, shards_of
from hirelode.llm.packing import fill_report, first_fit_decreasing, packed
from hirelode.llm.tokens import VOCABULARY, encoder, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
DOC = "doc_id bigint, text string, source string, n_tokens int, pack_id int"


@given(st.lists(st.integers(1, 20), min_size=1, max_size=60), st.integers(20, 40))
@settings(deadline=None)
def test_first_fit_decreasing_is_the_plain_one(sizes, capacity):
    got = first_fit_decreasing(np.array(sizes), capacity)
    rooms, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((k for k, r in enumerate(rooms) if r >= sizes[i]), len(rooms))
        if at == len(rooms):
            rooms.append(capacity)
        rooms[at] -= sizes[i]
        want[i] = at
    assert got.tolist() == want


def test_packing(spark):
    rows = [(1, "một hai ba " * 200, "a", 1, 1), (2, "x", None, 1, 1), (3, None, "a", 1, 1), (4, "", "b", 1, 1), (None, "y", "b", 1, 1), (5, "bốn năm", "b", 1, 1)]
    docs = spark.createDataFrame(rows, DOC)
    sizes = spark.createDataFrame([(1, 64), (2, 100000), (3, None), (None, 5), (4, 0)], "pack_id int, capacity_tokens int")
    got = packed(docs, sizes).collect()
    n = {i: len(encoder(VOCABULARY).encode_ordinary(t)) for i, t, *_ in rows if i and t}
    for pack, cap in ((1, 64), (2, 100000)):
        mine = [r for r in got if r.pack_id == pack]
        assert {i: sum(r.n_tokens for r in mine if r.doc_id == i) for i in n} == n
        room = {}
        for r in mine:
            room[r.container_id] = room.get(r.container_id, 0) + r.n_tokens
        assert max(room.values()) <= cap and {r.pack_id for r in got} == {1, 2}
        assert all(r.start_token == (r.piece_no - 1) * cap for r in mine) and all(r.n_tokens == cap for r in mine if r.start_token + cap <= n[r.doc_id])
    again = packed(docs.unionByName(docs), sizes).groupBy("pack_id", "container_id").agg({"n_tokens": "sum"}).collect()
    assert max(r[2] for r in again if r.pack_id == 1) <= 64 and sum(r[2] for r in again if r.pack_id == 1) == 2 * sum(n.values())
    assert packed(docs.limit(0), sizes).count() == 0 and packed(docs, sizes.limit(0)).count() == 0


def test_groups_are_bounded_by_texts_not_by_pieces(spark, monkeypatch):
    """Long texts and a small capacity: what fills containers by itself is in no group."""
    from hirelode.llm import packing

    seen = []
    monkeypatch.setattr(packing, "GROUP", 10)
    monkeypatch.setattr(packing, "first_fit_decreasing", lambda sizes, capacity: seen.append(len(sizes)) or np.arange(len(sizes)))
    one = packing._pack.__globals__["pd"].DataFrame({"pack_id": [1] * 3, "group_no": 0, "capacity_tokens": 4, "doc_id": [1, 2, 3], "piece_no": 1, "start_token": 0, "n_tokens": [1, 2, 3]})
    assert len(packing._pack(one)) == 3 and seen == [3]
    monkeypatch.undo()
    docs = spark.createDataFrame([(i, "một hai ba " * 2000, "a", 1, 1) for i in range(40)], DOC)
    got = packed(docs, spark.createDataFrame([(1, 8)], "pack_id int, capacity_tokens int")).selectExpr("container_id like '%:%' as grouped").groupBy("grouped").count().collect()
    assert {r.grouped: r["count"] for r in got}.get(True, 0) <= 40


def test_fill(spark, data):
    docs, sizes = (spark.read.parquet(f"{data}/../sf0.01/{t}.parquet") for t in ("documents", "pack_sizes"))
    fill = {r.capacity_tokens: r.fill for r in fill_report(packed(docs, sizes), sizes).collect()}
    assert len(fill) == 5 and min(fill.values()) > 0.95


@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 5))
@settings(deadline=None)
def test_split_is_exact(quotas, shards, seed):
    """Every block has one shard, shards are even, and a block's shard doesn't depend on which others a task holds."""
    source = np.repeat(np.arange(len(quotas)), quotas)
    rank = np.concatenate([np.arange(q) for q in quotas]) if quotas else source
    got = shards_of(np.array(quotas), shards, [seed], source, rank)
    sizes = np.bincount(got, minlength=shards) if len(got) else np.zeros(shards)
    assert len(sizes) == shards and sizes.max() - sizes.min() <= 1
    half = np.arange(len(got)) % 2 == 0
    assert (shards_of(np.array(quotas), shards, [seed], source[half], rank[half]) == got[half]).all()


def test_many_shards_are_reached_without_writing_out_the_tree():
    """Far beyond what a table of shards and sources could hold."""
    quotas = np.array([3 * 10**8, 10**8, 7])
    rank = np.array([0, 10**8 - 1, 5 * 10**7])
    got = shards_of(quotas, 6 * 10**6, [1, 2], np.array([1, 1, 1]), rank)
    assert 0 <= got[0] < got[2] < got[1] < 6 * 10**6 and abs(got[2] - 3 * 10**6) < 5000


def test_blocks_grow_and_are_not_lost(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 3)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 4)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 1)
    docs = spark.createDataFrame([(i, f"lời {i} cho bạn", "a" if i % 3 else "b", 0, 0) for i in range(90)], DOC)
    out, shares = mixture(docs, spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.5, 1)], "mix_id int, source string, target_share double, max_repeats int"))
    rows = out.collect()
    assert len(rows) == sum(r.n_texts for r in shares.collect()) > 0 and max(r.shard for r in rows) < 8


def test_plan():
    assert plan({"a": 100, "b": 1000}, [("a", 0.5, 2), ("b", 0.5, 1), ("none", 0.0, 1)]) == {"a": 200.0, "b": 200.0}
    assert plan({}, [("a", 1.0, 1)]) == {}


def test_mixture(spark):
    rows = [(i, f"lời {i} " * (3 + i % 7), "big" if i % 3 else "small", 0, 0) for i in range(600)] + [(900, None, "big", 0, 0), (901, "x", None, 0, 0), (None, "y", "big", 0, 0)]
    docs = spark.createDataFrame(rows, DOC)
    targets = spark.createDataFrame([(1, "big", 0.4, 1), (1, "small", 0.6, 3), (1, "gone", 0.1, 1), (2, "small", 1.0, None), (None, "big", 1.0, 1), (3, "big", 0.5, 0), (3, "small", 0.5, 1)], "mix_id int, source string, target_share double, max_repeats int")
    out, shares = mixture(docs, targets)
    got = out.collect()
    share = {(r.mix_id, r.source): r for r in shares.collect()}
    assert abs(share[1, "big"].actual_share - 0.4) < 0.02 and abs(share[1, "small"].actual_share - 0.6) < 0.02 and share[1, "gone"].n_tokens == 0
    assert share[3, "big"].n_tokens == 0 and share[3, "small"].actual_share == 1.0
    assert share[1, "small"].most_repeats <= 3 and share[2, "small"].most_repeats == 1
    assert len({(r.mix_id, r.shard, r.position) for r in got}) == len(got) and len({(r.mix_id, r.doc_id, r.pass_no) for r in got}) == len(got)
    assert mixture(docs.limit(0), targets)[0].count() == 0 and mixture(docs, targets.limit(0))[1].count() == 0
    assert {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}[900] == 0
