from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import types as T

from tests.llm.test_topk import clusters, whole
from veridraft.llm import negatives

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()),
    T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("place", T.StringType()),
    T.StructField("uid", T.StringType()),
])


def table(spark, rows):
    return spark.createDataFrame([(i, label, v, "x", "y") for i, label, v in rows], SCHEMA)


def slow(anchors, rows, positives=5, count=5):
    good = [(i, label, w) for i, label, v in rows if i is not None and label is not None and (w := whole(v, 256)) is not None]
    found = []
    for a, label, v in anchors:
        if a is None or label is None or (w := whole(v, 256)) is None:
            continue
        scores = [(-sum(x * y for x, y in zip(w, r)), i, other) for i, other, r in good]
        same = sorted((s, i) for s, i, other in scores if other == label and i != a)[:positives]
        for s, p in same:
            window = sorted((t, i) for t, i, other in scores if other != label and 80 * -s <= 100 * -t <= 100 * -s)
            found += [(a, p, n, i, -s, -t) for n, (t, i) in enumerate(window[:count], 1)]
    return sorted(found)


def result(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in df.select(names).collect())


@pytest.mark.parametrize("spread, hot", [(0.05, 0.0), (0.6, 0.0), (0.6, 0.7)])
def test_against_all_products(spark, spread, hot):
    rng = np.random.default_rng(int(spread * 100))
    vectors = clusters(rng, 800, 10, spread, 1.0)
    vectors += vectors[:30] + [vectors[3]] * 50  # ties
    labels = np.where(rng.random(len(vectors)) < hot, 1, rng.integers(0, 4, len(vectors))).tolist()
    rows = list(zip(rng.permutation(5000)[: len(vectors)].tolist(), labels, vectors))
    anchors = rows[::20]
    got = result(negatives.hard_negatives(table(spark, anchors), table(spark, rows)))
    want = slow(anchors, rows)
    assert got == want and len(want) > 100


def test_odd_rows(spark):
    """Nulls, infinities, empty, unlike sizes, negative and zero scores, repeated rows and anchors."""
    vectors = [
        None, [], [1.0, None], [float("nan"), 1.0], [float("-inf"), 1.0], [1.0], [1.0, 2.0, 3.0], [-1.0, -2.0, -3.0],
        [0.0, 0.0, 0.0], [1.0, 2.0, 3.0], [0.9, 1.9, 2.9], [1.0, 2.0, 2.5], [0.5], [0.8, 1.0],
    ]
    rows = [(i, i % 2, v) for i, v in enumerate(vectors)] + [(None, 1, [9.0, 9.0, 9.0]), (20, None, [1.0, 2.0, 3.0])]
    rows += [(6, 0, [1.0, 2.0, 3.0]), (6, 0, [5.0, 5.0, 5.0]), (11, 1, [1.0, 2.0, 2.5]), (10, 0, [0.9, 1.9, 2.9])]
    df = table(spark, rows)
    want = slow(rows, rows)
    assert result(negatives.hard_negatives(df, df)) == want and want
    assert result(negatives.hard_negatives(df, table(spark, []))) == []
    assert result(negatives.hard_negatives(table(spark, []), df)) == []
    one = table(spark, [r for r in rows if r[1] == 1])
    assert result(negatives.hard_negatives(one, one)) == []




def test_boxes_hold_their_rows_and_prune(monkeypatch):
    """Intervals bound every product; far boxes are never opened."""
    import pyarrow as pa

    monkeypatch.setattr(negatives, "TaskContext", type("C", (), {"get": staticmethod(
        lambda: type("P", (), {"partitionId": staticmethod(lambda: 0)}))}))
    rng = np.random.default_rng(8)
    mat = np.rint(np.array(clusters(rng, 4000, 6, 0.05, 1.0)) * 256).astype(np.int32)
    labels = rng.integers(0, 3, len(mat))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(mat))), pa.array(labels), pa.array([r.tobytes() for r in mat], pa.binary())],
        ["id", "label", "vec"],
    )
    made = list(negatives._trees(iter([batch])))
    assert len(made) == 1
    row = {f"r_{k}": v for k, v in made[0].to_pylist()[0].items()}
    tree = negatives.Tree.read(row, "r_").open(row)
    assert sorted(tree.ids) == list(range(len(mat))) and len(tree.ends) - 1 == -(-len(mat) // negatives.LEAF)
    n = 30
    full = np.full(n, negatives.TOP)
    fields = {"uid": np.arange(n), "mark": np.zeros(n, np.int64), "floor": np.full(n, negatives.NONE), "roof": full}
    ask = {f"q_{k}": v.tobytes() for k, v in fields.items()} | {
        "q_place": np.zeros(n, np.int32).tobytes(), "q_ids": np.arange(n).tobytes(), "q_labels": labels[:n].tobytes(),
        "q_mat": mat[:n].tobytes(), "q_n": n, "q_dim": 6,
    }
    asked = negatives.Asked.read(ask, "q_").open(ask, 5)
    least, largest = asked.intervals(tree.low, tree.high)
    scores = mat[:n].astype(np.int64) @ tree.mat.T.astype(np.int64)
    leaves = 0
    for node in range(tree.first_leaf, len(tree.low)):
        part = scores[:, tree.leaf(node)]
        assert (least[:, node] <= part.min(1)).all() and (largest[:, node] >= part.max(1)).all()
        leaves += 1
    assert leaves == len(tree.ends) - 1
    opened = negatives.visit(asked, tree, same=True)
    assert 0 < opened < leaves
    for q in range(n):
        fit = [(-s, i) for s, i, other in zip(scores[q], tree.ids, tree.labels) if other == labels[q] and i != q]
        assert [-s for s, _ in sorted(fit)[:5]] == asked.best.scores[q].tolist()
        assert [i for _, i in sorted(fit)[:5]] == asked.best.ids[q].tolist()
