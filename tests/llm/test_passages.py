from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tests.llm.cases import documents, odd_texts, words
from veridraft.llm import passages


def slow(ids, texts):
    """Every 100-byte window against all earlier ones."""
    data = [(t or "").encode() for t in texts]
    first = {}
    for i, d in sorted(zip(ids, data), key=lambda x: x[0]):
        for p in range(len(d) - 99):
            w = d[p : p + 100]
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = {}
    for i, d in zip(ids, data):
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - 99):
            if first[d[p : p + 100]] < (i, p):
                gone[p : p + 100] = True
        left = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(d), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def fast(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.remove_repeats(df, with_bytes=False).collect()}


def corpus(seed):
    """Shared passages in different surroundings, edits, periods and copies within a text."""
    rng = random.Random(seed)
    shared = [words(rng, rng.choice([15, 30, 60, 200])) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            if kind < 0.4:
                parts.append(words(rng, rng.randint(1, 60)))
            elif kind < 0.8:
                x = rng.choice(shared)
                a = rng.randrange(len(x))
                parts.append(x[a:] if rng.random() < 0.5 else x[: a + 90])
            elif kind < 0.9:
                parts.append(rng.choice(["=", "ab", "xyz-", "é"]) * rng.randint(30, 300))
            else:
                x = list(rng.choice(shared))
                x[rng.randrange(len(x))] = "#"
                parts.append("".join(x))
        texts.append(rng.choice(["", " ", "\n"]).join(parts))
    return rng, texts


@pytest.mark.parametrize("seed,chunk", [(1, 12 << 20), (2, 1), (3, 3000), (4, 500)])
def test_against_all_windows(spark, monkeypatch, seed, chunk):
    rng, texts = corpus(seed)
    ids = rng.sample(range(-50, 1000), len(texts))
    df = documents(spark, texts, ids).repartition(3)
    monkeypatch.setattr(passages, "CHUNK_BYTES", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert fast(df) == slow(ids, texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_phrases_hold_every_window_once():
    rng = random.Random(9)
    texts = [words(rng, 400).encode(), b"", b"x" * 99, b"y" * 100, b"ab" * 300, words(rng, 50).encode()]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    starts, n, trigger, lead = passages.phrases(b"".join(texts), offsets)
    windows = np.concatenate([np.arange(s, s + k) for s, k in zip(starts, n)])
    want = np.concatenate([np.arange(o, o + max(0, len(t) - 99)) for o, t in zip(offsets, texts)])
    assert (windows == want).all() and len(trigger) == len(starts)
    assert ((lead >= 0) & (lead <= 80) & (lead >= n - 1)).all()


def test_odd_texts_nulls_and_repeated_rows(spark):
    rng = random.Random(6)
    texts = odd_texts(rng)
    texts = [t if t is None or len(t) < 3000 else t[:3000] for t in texts]
    ids = list(range(len(texts)))
    assert fast(documents(spark, texts, ids)) == slow(ids, texts)
    same = words(rng, 100)
    df = documents(spark, [same, same, same, "z" + same], [5, 5, 9, None], extra=["n_spans", "kind"])
    rows = passages.remove_repeats(df, columns=df.columns).collect()
    by = {(r.doc_id, r.n_removed == 0) for r in rows}
    assert by == {(None, True), (5, False), (9, False)} and len(rows) == 4
    assert {bytes(r.kept_bytes) for r in rows} == {b"", ("z" + same).encode()}
    assert passages.remove_repeats(documents(spark, [])).count() == 0
    two = passages.remove_repeats(documents(spark, [same, same], [5, 5])).collect()
    assert [r.n_removed for r in two] == [0, 0]
