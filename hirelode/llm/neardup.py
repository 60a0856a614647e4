"""Near-duplicate texts by count vectors: tiles, R-trees, bound, exact check.

Each text is the set of its words with their occurrence numbers, so that the
words two texts have in common, counted with repetition, are a set intersection.
Words are hashed into :data:`GROUPS` groups; a text is the point of its group
counts, and the sum of the coordinate minima of two points is never less than
their overlap.  Points are brought together in tiles by weighted minimum hashes
(rare words weigh more); only numbers are shuffled for that, and a text alone in
its tile goes no further.  Within a tile an R-tree over the points is joined
with itself, discarding nodes, then points, whose bound is too low; what
survives is checked exactly.  Texts with equal words are one class with one
point.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, written

GROUPS = 256
#: Each band takes ROWS of the HASHES: runs of neighbours first, then one of every fifth part; two bands have one in common at most.
HASHES, ROWS, BANDS = 160, 5, 60
#: Words in fewer than this share of the texts weigh alike; the others, at most words-a-text / RARE of them, are sent to every task.
RARE = 1 / 200
LEAF, HOT = 32, 4096
#: A list of hot tiles or classes up to this many rows is sent to every task, a longer one is joined by shuffle.
SENT = 50_000
SIEVE = 1 << 24
FULL = 15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


_WORDS = re.compile(r"[^\W_]+")


def _packed(counts: np.ndarray) -> np.ndarray:
    """Group counts as half bytes; FULL stands for FULL or more, see :func:`_bound`."""
    low = np.minimum(counts, FULL).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << 4)


def _unpacked(data: np.ndarray) -> np.ndarray:
    out = np.empty((data.shape[0], data.shape[1] * 2), np.uint8)
    out[:, ::2], out[:, 1::2] = data & 15, data >> 4
    return out


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, k1, k2, n, vec, toks`` of ``id, text``: a 128-bit key of the whole bag, the number of words, the point, and 64-bit tokens of word and occurrence.

    Words are runs of letters and digits, lower-cased; a text without any is left out.
    """
    known: dict[str, int] = {}
    for whole in batches:
        for i in range(0, whole.num_rows, 4096):
            batch = whole.slice(i, 4096)
            words = [_WORDS.findall(t.lower()) for t in batch.column("text").to_pylist()]
            size = np.fromiter(map(len, words), np.int64, len(words))
            keep = np.flatnonzero(size)
            if not len(keep):
                continue
            flat = list(chain.from_iterable(words))
            for w in set(flat).difference(known):
                known[w] = xxhash.xxh64_intdigest(w)
            h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
            if len(known) > 500_000:
                known = {}
            size = size[keep]
            at = np.concatenate([[0], np.cumsum(size)[:-1]])
            doc = np.repeat(np.arange(len(keep)), size)
            # one sort of numbers: the text's place in the batch (12 bits), then 52 bits of the word's hash
            h = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            tok = _mix((h << np.uint64(12)) + (np.arange(len(h)) - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            k1, k2 = np.add.reduceat(_mix(tok ^ _M1), at), np.add.reduceat(_mix(tok ^ _M2), at)
            ends = pa.array(np.concatenate([at, [len(tok)]]).astype(np.int32))
            toks = pa.ListArray.from_arrays(ends, pa.array(tok.view(np.int64)))
            vec = np.bincount(doc * GROUPS + (tok % np.uint64(GROUPS)).astype(np.int64), minlength=len(keep) * GROUPS).reshape(-1, GROUPS)
            vecs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(GROUPS // 2), len(keep), [None, pa.py_buffer(_packed(vec).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(keep)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(size.astype(np.int32)), vecs, toks],
                names=["id", "k1", "k2", "n", "vec", "toks"],
            )


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``t, n``: in how many texts of the batch each token is."""
    for batch in batches:
        t, n = np.unique(batch.column("toks").flatten().to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], names=["t", "n"])


def _tiles(weights: tuple[np.ndarray, np.ndarray], top: float):
    """``tile, id`` of ``id, k1, k2, toks``: a row for each band of a text; of equal bags in a batch only the least id.

    The hashes of a token are kept as the 16 upper bits of an exponential
    draw's order of magnitude and fraction, so that minima keep their order and
    equal minima of different tokens are rare; they are kept from batch to batch.
    """
    seeds = _mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    runs = np.arange(HASHES).reshape(-1, ROWS)
    bands = np.concatenate([runs, runs.reshape(ROWS, -1).T])[:BANDS]
    known, heavy = weights

    def drawn(tokens: np.ndarray) -> np.ndarray:
        w = np.full(len(tokens), top, np.float32)
        if len(known):
            k = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            w = np.where(known[k] == tokens, heavy[k], w).astype(np.float32)
        out = np.empty((len(tokens), HASHES), np.uint16)
        for i in range(0, len(tokens), 1024):
            u = (_mix(tokens[i : i + 1024, None] ^ seeds[None, :]) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24) + np.float32(2.0**-25)
            cost = -np.log(u) / w[i : i + 1024, None]
            # 11 bits of the fraction and 32 powers of two, from 2**-26 on
            out[i : i + 1024] = np.clip((cost.view(np.uint32) >> np.uint32(12)).astype(np.int64) - ((127 - 26) << 11), 0, 65535)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, table = np.zeros(0, np.uint64), np.zeros((0, HASHES), np.uint16)
        for whole in batches:
            ids = whole.column("id").to_numpy(zero_copy_only=False)
            bag = _mix(whole.column("k1").to_numpy(zero_copy_only=False).view(np.uint64)) ^ whole.column("k2").to_numpy(zero_copy_only=False).view(np.uint64)
            order = np.lexsort((ids, bag))
            heads = np.sort(order[np.concatenate([[True], bag[order][1:] != bag[order][:-1]])]) if len(order) else order
            whole = whole.take(pa.array(heads))
            ids = ids[heads]
            for i in range(0, len(heads), 4096):
                lists = whole.slice(i, 4096).column("toks")
                offsets = _offsets(lists)
                n = np.diff(offsets)
                tok = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                unique, code = np.unique(tok, return_inverse=True)
                new = np.setdiff1d(unique, held, assume_unique=True)
                if len(new):
                    if len(held) + len(new) > 120_000:  # about 70 MB
                        held, table, new = np.zeros(0, np.uint64), np.zeros((0, HASHES), np.uint16), unique
                    both, drawn_new = np.concatenate([held, new]), drawn(new)
                    place = np.argsort(both)
                    held, table = both[place], np.concatenate([table, drawn_new])[place]
                row = np.searchsorted(held, unique)[code]
                low = np.empty((len(n), HASHES), np.uint16)
                for j in range(0, len(n), 128):  # so that the gathered rows stay in the cache
                    a, b = offsets[j], offsets[min(j + 128, len(n))]
                    low[j : j + 128] = np.minimum.reduceat(table[row[a:b]], offsets[j : min(j + 128, len(n))] - a, axis=0)
                key = np.zeros((len(n), BANDS), np.uint64)
                for r in range(ROWS):
                    key = _mix(key * np.uint64(31) + low[:, bands[:, r]] + np.uint64(r))
                key = _mix(key ^ seeds[None, :BANDS])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids[i : i + 4096], BANDS))], names=["tile", "id"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by tile and id those whose tile holds another text."""
    last: tuple | None = None  # the row before, not yet given out unless its tile is known to be shared
    for batch in batches:
        if not batch.num_rows:
            continue
        tile, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "id"))
        shared = False
        if last is not None:
            tile, ids, shared = np.concatenate([[last[0]], tile]), np.concatenate([[last[1]], ids]), last[2]
        same = tile[1:] == tile[:-1]
        keep = np.zeros(len(tile), bool)
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= shared
        last = (tile[-1], ids[-1], bool(keep[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(tile[:-1][keep[:-1]]), pa.array(ids[:-1][keep[:-1]])], names=["tile", "id"])
    if last is not None and last[2]:
        yield pa.RecordBatch.from_arrays([pa.array(np.array([last[0]])), pa.array(np.array([last[1]]))], names=["tile", "id"])


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of coordinate minima; FULL stands for FULL or more, so where both have it nothing is bounded."""
    low = np.minimum(a, b)
    s = low.sum(-1, dtype=np.int64)
    return np.where((low == FULL).any(-1), np.iinfo(np.int64).max, s)


def tree_pairs(vec: np.ndarray, n: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose bound reaches ``share`` of the longer text, by joining an R-tree with itself.

    The tree is packed by halving along the length first, then along the group
    with the widest spread, down to leaves of :data:`LEAF` points.
    """
    leaves: list[np.ndarray] = []
    stack = [(np.argsort(n, kind="stable"), 0)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) <= LEAF:
            leaves.append(ids)
            continue
        axis = n if depth % 3 == 0 else vec[:, int(np.argmax(vec[ids].max(0).astype(int) - vec[ids].min(0)))]
        ids = ids[np.argsort(axis[ids], kind="stable")]
        stack += [(ids[: len(ids) // 2], depth + 1), (ids[len(ids) // 2 :], depth + 1)]
    top = np.array([vec[x].max(0) for x in leaves])
    least, most = np.array([n[x].min() for x in leaves]), np.array([n[x].max() for x in leaves])
    left, right = [], []
    for i in range(len(leaves)):
        js = np.arange(i, len(leaves))
        js = js[(most[js] >= share * least[i]) & (most[i] >= share * least[js])]
        js = js[_bound(top[js], top[i]) >= share * np.maximum(least[js], least[i])]
        for j in js:
            p, q = leaves[i], leaves[j]
            ok = _bound(vec[p][:, None, :], vec[q][None, :, :]) >= share * np.maximum(n[p][:, None], n[q][None, :])
            x, y = np.nonzero(np.triu(ok, 1) if i == j else ok)
            left.append(p[x])
            right.append(q[y])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _candidates(share: float):
    """``a, b``: pairs of one tile that pass the bound.  Rows come sorted by tile; ``side`` 2 joins with all, 0 with 1 only."""

    def flush(tile: np.ndarray, ids: np.ndarray, bag: np.ndarray, n: np.ndarray, vec: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, bag, side, tile))  # the least id stands for its bag
        new = np.ones(len(order), bool)
        same = (tile[order][1:] == tile[order][:-1]) & (bag[order][1:] == bag[order][:-1]) & (side[order][1:] == side[order][:-1])
        new[1:] = ~same
        order = order[new]
        tile, ids, n, vec, side = tile[order], ids[order], n[order], _unpacked(vec[order]), side[order]
        starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(tile)]]))
        left, right = [], []
        small = np.repeat(sizes <= 2 * LEAF, sizes)
        place = np.arange(len(tile)) - np.repeat(starts, sizes)
        rest = np.repeat(sizes, sizes) - place
        for d in range(1, min(2 * LEAF, int(sizes.max()) if len(sizes) else 0)):
            i = np.flatnonzero(small & (rest > d))
            j = i + d
            ok = np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j])
            i, j = i[ok], j[ok]
            ok = _bound(vec[i], vec[j]) >= share * np.maximum(n[i], n[j])
            left.append(i[ok])
            right.append(j[ok])
        for s, k in zip(starts[sizes > 2 * LEAF], sizes[sizes > 2 * LEAF]):
            x, y = tree_pairs(vec[s : s + k], n[s : s + k], share)
            left.append(x + s)
            right.append(y + s)
        i, j = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
        ok = (side[i] == 2) | (side[i] != side[j])
        a, b = ids[i[ok]], ids[j[ok]]
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile, ids, bag, n, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "id", "bag", "n", "side"))
            vec = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.uint8).reshape(-1, GROUPS // 2)
            held.append((tile, ids, bag, n, vec, side))
            if tile[-1] == held[0][0][0]:
                continue
            whole = [np.concatenate([h[k] for h in held]) for k in range(6)]
            cut_at = int(np.searchsorted(whole[0], whole[0][-1]))  # the last tile may go on in the next batch
            yield flush(*[w[:cut_at] for w in whole])
            held = [tuple(w[cut_at:] for w in whole)]
        if held:
            yield flush(*[np.concatenate([h[k] for h in held]) for k in range(6)])

    return run


def _sieve(ids: DataFrame) -> np.ndarray:
    """A bit map of fixed size (:data:`SIEVE` bits) of hashed ids: what it lacks isn't among them."""
    bit = F.pmod(F.xxhash64("id"), F.lit(SIEVE))
    words = ids.select(bit.alias("bit")).selectExpr("cast(bit div 64 as int) as w", "shiftleft(1L, cast(bit % 64 as int)) as m")
    rows = words.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()  # at most SIEVE / 64 rows
    out = np.zeros(SIEVE // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return out


def _sieved(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy(zero_copy_only=False)
            yield batch.select(["id", "toks"]).filter(pa.array((bits[at >> 6] >> (at & 63)) & 1 == 1))

    return run


def near_duplicates(texts: DataFrame, key: str, columns: list[str], share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)`` of the rows of ``texts``.

    ``members``: ``id`` and ``class_id``, the least id with the same words,
    counted with repetition.  ``pairs``: ``a < b`` and ``overlap``, the pairs of
    class ids whose common words are at least ``share`` of the longer text's.
    Nulls are empty texts; a text without a word, or without an id, has no class
    and no pair; if an id repeats, each of its texts counts.  Texts are taken
    whole.  The tiles find a pair of weighted Jaccard similarity ``j`` with
    probability ``1 - (1 - j**ROWS)**BANDS`` about: 0.9998 at 2/3, which is an
    overlap of 0.8 with equal weights and lengths, less if the differing words
    are rarer.  It is not exact; everything that is brought together is decided
    exactly.
    """
    bags = texts.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.concat_ws(" ", *columns).alias("text"))
    bags = written(bags.mapInArrow(_word_sets, "id bigint, k1 bigint, k2 bigint, n int, vec binary, toks array<bigint>"), "bags")
    keys = bags.select("id", "k1", "k2").distinct()
    members = keys.join(keys.groupBy("k1", "k2").agg(F.min("id").alias("class_id")), ["k1", "k2"]).select("id", "class_id").distinct()
    total = bags.count()
    common = bags.select("toks").mapInArrow(_token_counts, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= RARE * total)
    rows = common.select("t", F.log(F.lit(total + 1.0) / F.col("n")).alias("w")).toPandas()  # at most words-a-text / RARE rows
    tok, w = rows["t"].to_numpy(np.int64).view(np.uint64), np.maximum(rows["w"].to_numpy(np.float64), 1e-3)
    order = np.argsort(tok)
    tiles = bags.select("id", "k1", "k2", "toks").mapInArrow(_tiles((tok[order], w[order]), float(-np.log(RARE))), "tile bigint, id bigint")
    met = written(tiles.repartition("tile").sortWithinPartitions("tile", "id").mapInArrow(_met, "tile bigint, id bigint"), "met")
    points = bags.select("id", F.xxhash64("k1", "k2").alias("bag"), "n", "vec")
    tiles = met.join(points, "id")
    hot = cut(met.groupBy("tile").count().where(F.col("count") > HOT).withColumn("blocks", F.ceil(F.col("count") / HOT).cast("int")).drop("count"))
    sides = tiles.join(F.broadcast(hot) if hot.count() <= SENT else hot, "tile", "left")
    own = F.pmod(F.xxhash64("bag"), F.col("blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j"), F.when(j == own, 2).when(own < j, 0).otherwise(1).alias("side")),
    )
    plain = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))
    sides = sides.select("tile", "id", "bag", "n", "vec", F.inline(F.when(F.col("blocks").isNull(), plain).otherwise(cells)))
    sides = sides.select(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("tile")).otherwise(F.xxhash64("tile", "i", "j")).alias("tile"), "id", "bag", "n", "vec", F.col("side").cast("int").alias("side"))
    sides = sides.repartition("tile").sortWithinPartitions("tile")
    near = written(sides.mapInArrow(_candidates(share), "a bigint, b bigint").distinct(), "near")
    bits = _sieve(near.select(F.explode(F.array("a", "b")).alias("id")))
    chosen = bags.select("id", F.pmod(F.xxhash64("id"), F.lit(SIEVE)).alias("bit"), "toks").mapInArrow(_sieved(bits), "id bigint, toks array<bigint>")
    chosen = written(chosen, "chosen")
    left, right = chosen.select(F.col("id").alias("a"), F.col("toks").alias("ta")), chosen.select(F.col("id").alias("b"), F.col("toks").alias("tb"))
    pairs = near.join(left, "a").join(right, "b")
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("ta", "tb")) / F.greatest(F.size("ta"), F.size("tb")))
    pairs = pairs.where(F.col("overlap") >= share - 1e-9).groupBy("a", "b").agg(F.max("overlap").alias("overlap"))
    return cut(members), cut(pairs)


def all_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b`` with ``a < b``: every pair of rows in one class or in two linked classes.

    The result is what it is: a class of n copies makes n² / 2 rows.  A class of
    more than :data:`HOT` rows is dealt into blocks, and its pairs are made block
    by block, so that no task makes those of a whole class.
    """
    sizes = members.groupBy("class_id").agg(F.count("*").alias("size")).where(F.col("size") > HOT)
    big = cut(sizes.select("class_id", F.ceil(F.col("size") / HOT).cast("int").alias("blocks")))
    dealt = members.join(F.broadcast(big) if big.count() <= SENT else big, "class_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("slot", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    m = lambda i, *more: dealt.select("class_id", F.col("id").alias(i), *more)
    inside = m("x", "slot", F.explode(every).alias("other")).join(m("y", F.col("slot").alias("other"), F.explode(every).alias("slot")), ["class_id", "slot", "other"]).where("x < y")
    ends = lambda c, i: dealt.select(F.col("class_id").alias(c), F.col("id").alias(i), F.col("slot").alias(f"{i}_slot"))
    blocks = big.select(F.col("class_id").alias("a"), F.col("blocks").alias("na"))
    linked = pairs.select("a", "b").join(blocks, "a", "left").join(big.select(F.col("class_id").alias("b"), F.col("blocks").alias("nb")), "b", "left")
    linked = linked.select("a", "b", F.explode(F.sequence(F.lit(0), F.coalesce("na", F.lit(1)) - 1)).alias("x_slot"), F.coalesce("nb", F.lit(1)).alias("nb"))
    linked = linked.select("a", "b", "x_slot", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("y_slot"))
    across = linked.join(ends("a", "x"), ["a", "x_slot"]).join(ends("b", "y"), ["b", "y_slot"])
    both = across.select("x", "y").unionByName(inside.select("x", "y"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def linked_members(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id, class_id, n_links``: one row per text with the number of texts it is linked to; no pair of copies is written out."""
    size = members.groupBy("class_id").agg(F.count("*").alias("size"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(size.withColumnRenamed("class_id", "b"), "b").groupBy("a").agg(F.sum("size").alias("others")).withColumnRenamed("a", "class_id")
    per = size.join(other, "class_id", "left").select("class_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(per, "class_id").select("id", "class_id", "n_links")
