from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import types as T

from veridraft.llm import topk
from veridraft.llm.vectors import Best, Block, lengths, products

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.StringType()), T.StructField("score", T.StringType()), T.StructField("group", T.StringType()),
])


def table(spark, rows):
    """Rows of (id, vector), with columns whose names the search uses itself."""
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)


def whole(vector, scale=64):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(scale * x) for x in vector]


def slow(queries, rows, k, own=False):
    found = []
    for q, a in queries:
        a = whole(a)
        if q is None or a is None:
            continue
        scores = [
            (-sum(x * y for x, y in zip(a, whole(b))), i)
            for i, b in rows if i is not None and whole(b) is not None and (own or i != q)
        ]
        found += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found)


def result(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def clusters(rng, n, dim, spread, longest):
    """Few directions, lengths over several orders: both ways of pruning have work."""
    centres = rng.normal(size=(6, dim))
    v = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * spread
    return (v / np.linalg.norm(v, axis=1)[:, None] * rng.uniform(0.01, longest, n)[:, None]).tolist()


@pytest.mark.parametrize("spread, longest", [(0.02, 30.0), (0.5, 1.0), (5.0, 3.0)])
def test_against_all_products(spark, spread, longest):
    rng = np.random.default_rng(int(spread * 100))
    vectors = clusters(rng, 900, 12, spread, longest)
    vectors += vectors[:40] + [vectors[7]] * 60  # ties
    rows = list(zip(rng.permutation(5000)[: len(vectors)].tolist(), vectors))
    queries = rows[::15]
    got = result(topk.exact_top_k(table(spark, queries), table(spark, rows), 7))
    assert got == slow(queries, rows, 7)


def test_odd_rows(spark):
    """Nulls, infinities, empty, unlike sizes, huge values, repeated rows, all scores negative, too few rows."""
    vectors = [
        None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [1.0, 2.0, 3.0], [-1.0, -2.0, -3.0],
        [0.0, 0.0, 0.0], [1.0, 2.0, 3.0], [0.001, -0.001, 0.0],
    ]
    rows = list(enumerate(vectors)) + [(None, [9.0, 9.0, 9.0]), (6, [1.0, 2.0, 3.0]), (6, [5.0, 5.0, 5.0])]
    df = table(spark, rows)
    for k in (1, 3, 20):
        assert result(topk.exact_top_k(df, df, k)) == slow(rows, rows, k)
        assert result(topk.exact_top_k(df, df, k, own=True)) == slow(rows, rows, k, own=True)
    assert result(topk.exact_top_k(df, table(spark, []), 3)) == []
    assert result(topk.exact_top_k(table(spark, []), df, 3)) == []
    most = int((1 << 31) / 2**0.5) - 1
    huge = [(1, [1e300, -1e300]), (2, [1e300, 1.0]), (3, [1e9, 1.0])]
    got = result(topk.exact_top_k(table(spark, huge), table(spark, huge), 1, scale=1))
    assert got == [(1, 1, 2, most * most - most), (2, 1, 1, most * most - most), (3, 1, 2, 10**9 * most + 1)]


def test_each_way_prunes():
    """Long rows of one direction first: later buckets cost few products, by length or by coordinates."""
    rng = np.random.default_rng(4)
    axis = np.eye(16)[0] * 3000
    near = np.rint(axis + rng.normal(size=(200, 16)) * 30).astype(np.int32)
    far = np.rint(rng.normal(size=(2000, 16)) * 450).astype(np.int32)
    short = np.rint(rng.normal(size=(2000, 16)) * 20).astype(np.int32)

    def bucket(mat, start):
        mat = mat[np.argsort(-lengths(mat), kind="stable")]
        return topk.Bucket(np.arange(start, start + len(mat)), np.zeros(len(mat), np.int64), mat).prepare()

    queries = Block(np.arange(10**6, 10**6 + 20), np.zeros(20, np.int64), near[:20])
    length, best = lengths(queries.mat), Best(20, 5)
    buckets = [bucket(near, 0), bucket(far, 1000), bucket(short, 5000)]
    spent = [topk.meet(queries, length, b, best) for b in buckets]
    assert spent[0] == {"length": 20 * 200, "coordinates": 0}
    assert spent[1]["length"] == 0 and spent[1]["coordinates"] < 20 * 2000 / 20
    assert spent[2] == {"length": 0, "coordinates": 0}
    rows = np.vstack([b.mat for b in buckets]).astype(np.int64)
    ids = np.concatenate([b.ids for b in buckets])
    for q in range(20):
        scores = rows @ queries.mat[q].astype(np.int64)
        order = np.lexsort((ids, -scores))[:5]
        assert (best.scores[q] == scores[order]).all() and (best.ids[q] == ids[order]).all()


def test_short_rows_are_cut_off():
    rng = np.random.default_rng(5)
    mat = np.rint(rng.normal(size=(3000, 8)) * np.geomspace(3000, 3, 3000)[:, None]).astype(np.int32)
    mat = mat[np.argsort(-lengths(mat), kind="stable")]
    whole = topk.Bucket(np.arange(3000), np.zeros(3000, np.int64), mat).prepare()
    queries = Block(np.arange(10**6, 10**6 + 5), np.zeros(5, np.int64), mat[:5])
    best = Best(5, 3)
    topk.meet(queries, lengths(queries.mat), topk.Bucket(whole.ids[:200], whole.labels[:200], mat[:200]).prepare(), best)
    rest = topk.Bucket(whole.ids[200:], whole.labels[200:], mat[200:]).prepare()
    spent = topk.meet(queries, lengths(queries.mat), rest, best)
    assert spent["length"] + spent["coordinates"] < 5 * 2800 / 2
    scores = mat.astype(np.int64) @ mat[:5].T.astype(np.int64)
    assert (best.scores == -np.sort(-scores, axis=0)[:3].T).all()


def test_products_are_exact():
    rng = np.random.default_rng(6)
    for most in (100, 10**5, 10**8, 10**9):
        a, b = (rng.integers(-most, most, (9, 4)).astype(np.int32) for _ in range(2))
        bound = lengths(a).max() * lengths(b).max()
        assert (products(a, b, bound) == a.astype(np.int64) @ b.astype(np.int64).T).all()
