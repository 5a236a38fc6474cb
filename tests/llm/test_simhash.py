from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from tests.llm.cases import documents, odd_texts, words
from veridraft.llm import simhash


def slow_fingerprint(text):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate(
        {i: 32 for i in range(9, 14)}).split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    smallest = {}
    for i, x in enumerate(ids):
        if x is not None:
            smallest[find(i)] = min(smallest.get(find(i), x), x)
    return [smallest.get(find(i)) for i in range(len(ids))]


def test_golay_finds_every_neighbour():
    golay, rng = simhash.Golay(), np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 4000)
    numbers = golay.number(v)
    assert {int(x).bit_count() for x in golay.error} == {0, 1, 2, 3}
    assert all(simhash._remainder(int(a ^ golay.error[golay.low[a & 0xFFF] ^ golay.high[a >> 12]])) == 0 for a in v)
    near = golay.near(v, 23)
    assert {int((row >= 0).sum()) for row in near} == {1, 6}
    for bit in range(23):
        assert (near == golay.number(v ^ (1 << bit))[:, None]).any(1).all()
    assert (near == numbers[:, None]).any(1).all()


def test_fingerprints():
    rng = random.Random(2)
    for text in [t or "" for t in odd_texts(rng)] + [words(rng, n) for n in (1, 2, 3, 4, 50)]:
        assert simhash.fingerprint(text) % (1 << 64) == slow_fingerprint(text)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_of_random_fingerprints(spark, seed):
    """Chains, balls around one point and far ones: components equal those of all pairs."""
    rng = random.Random(seed)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.choice([0, 1, 2, 12])):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])))
            prints.add(x)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.links(df)
    pairs = edges.collect()
    assert pairs and all(((a ^ b) % (1 << 64)).bit_count() <= 2 and a > b for a, b in pairs)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    want = slow_components(signed, prints)
    assert [root.get(x, x) for x in signed] == want


def test_documents_against_all_pairs(spark):
    rng = random.Random(5)
    texts = odd_texts(rng)
    for _ in range(25):
        base = words(rng, 400).split(" ")
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    ids = rng.sample(range(10_000), len(texts))
    rows = {r.doc_id: r for r in simhash.simhash_groups(documents(spark, texts, ids)).collect()}
    prints = [slow_fingerprint(t or "") for t in texts]
    assert [rows[i].fingerprint for i in ids] == [f"{x:016x}" for x in prints]
    assert [rows[i].component_id for i in ids] == slow_components(ids, prints)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.values())


def test_nulls_repeats_empty_and_clashes(spark):
    text = "some words that are the same"
    df = documents(spark, [text, text, text, "", None, "other words entirely"], [None, 4, 4, None, None, 9], extra=["kept", "fp"])
    rows = simhash.simhash_groups(df, columns=df.columns).collect()
    assert len(rows) == 6 and sum(r.kept for r in rows) == 3
    assert [r.component_id for r in rows if r.text == text] == [4, 4, 4]
    assert [r.component_id for r in rows if not r.text] == [None, None]
    assert [r.fingerprint for r in rows if not r.text] == ["0" * 16] * 2
    assert simhash.simhash_groups(documents(spark, [])).count() == 0
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert isinstance(simhash.simhash_groups(df).schema["component_id"].dataType, T.LongType)
