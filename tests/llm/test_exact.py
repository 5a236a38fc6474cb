from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from tests.llm.cases import documents, odd_texts, words
from veridraft.llm.exact import exact_groups


def expected(ids, texts, largest=True):
    groups = defaultdict(list)
    lower = [(t or "").translate({c: c + 32 for c in range(65, 91)}) for t in texts]
    for i, t in zip(ids, lower, strict=True):
        groups[t].append(i)
    out = []
    for i, t in zip(ids, lower, strict=True):
        real = [x for x in groups[t] if x is not None]
        out.append((i, (max if largest else min)(real) if real else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("runs", [1, 5, 64])
def test_brute_force(spark, keep, runs):
    rng = random.Random(runs)
    base = [words(rng, rng.randint(1, 5)) for _ in range(40)]
    texts = odd_texts(rng) + [rng.choice([str.upper, str.lower, str])(rng.choice(base)) for _ in range(300)] + ["Hot"] * 200
    ids = rng.sample(range(-500, 5000), len(texts))
    rows = exact_groups(documents(spark, texts, ids), keep=keep, runs=runs).collect()
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows)
    assert got == sorted(expected(ids, texts, keep == "largest"))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_null_and_repeated_ids(spark):
    texts, ids = ["a", "A", "a", "b", "b", "c", "c"], [None, 3, 3, None, None, 7, 7]
    rows = exact_groups(documents(spark, texts, ids)).collect()
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size) for r in rows))) == sorted(
        map(str, [(None, 3, 3), (3, 3, 3), (3, 3, 3), (None, None, 2), (None, None, 2), (7, 7, 2), (7, 7, 2)])
    )
    assert sum(r.kept for r in rows) == 3


def test_empty_and_clashing_columns(spark):
    assert exact_groups(documents(spark, [])).count() == 0
    df = documents(spark, ["x", "X", "y"], extra=["kept", "keep_id", "__run_of_mine"])
    rows = exact_groups(df, columns=df.columns).where("kept")
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "__run_of_mine", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(r.text for r in rows.collect()) == ["X", "y"]
