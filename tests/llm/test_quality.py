from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.cases import documents, odd_texts, words
from veridraft.llm import quality

FOLDER = "/root/testdata/sf0.1"


def slow_counts(text):
    w = re.findall("[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t\x0b\x1c\x85 #*<é"), max_size=60))
def test_counts(text):
    assert quality.count_rules(text) == slow_counts(text)


def test_hashing_of_words_and_stretches():
    """Equal n-grams share a bucket; the place in the text does not matter."""
    one, two = quality.hashed("ab cd ab  cd"), quality.hashed("  \nxy ab cd")
    assert one[0][0] == one[0][2] == two[0][1] and one[0][1] == one[0][3] == two[0][2]
    assert one[1][0] == one[1][2] == two[1][1]
    assert quality.hashed("") == quality.hashed(" \n") == []
    assert [len(x) for x in quality.hashed("a")] == [1]


def test_held_out_accuracy(spark):
    """Fitted on some labelled rows, right on at least 95 % of the others, and calibrated."""
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    known = docs.join(labels.selectExpr("doc_id", "quality"), "doc_id").select("doc_id", "text", "quality").collect()
    rng = random.Random(1)
    rng.shuffle(known)
    half = known[: len(known) // 2]
    model = quality.train(
        spark.createDataFrame([(r.doc_id, r.text) for r in half], "doc_id long, text string"),
        spark.createDataFrame([(r.doc_id, r.quality) for r in half], "doc_id long, quality int"),
    )
    rest = [r for r in known[len(known) // 2 :] if quality.count_rules(r.text)[0] >= 50]
    p = np.array([model.probability(r.text) for r in rest])
    y = np.array([r.quality for r in rest])
    assert ((p >= quality.KEEP_FROM) == y).mean() >= 0.95
    assert abs(p.mean() - y.mean()) < 0.03


def test_rows_against_the_plain_form(spark):
    rng = random.Random(2)
    texts = odd_texts(rng) + [words(rng, n) for n in (49, 50, 51, 200)] + ["a b c d " * 30]
    df = documents(spark, texts, extra=["kept", "n_words"])
    model = quality.PASS_ALL
    rows = {r.doc_id: r for r in quality.quality_rules(df, model, columns=df.columns).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        if len(t or "") < 2000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_counts(t or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed) and r.text == t


def test_labels_null_missing_and_contradicting(spark):
    docs = documents(spark, [], extra=["quality"])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, empty) is quality.PASS_ALL
    one = quality.train(documents(spark, ["a b", "c"]), spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int"))
    assert one.probability("anything") > 0.99  # one kind of label: every text passes
    assert quality.quality_rules(docs, quality.PASS_ALL).count() == 0
    texts = [("good words " if k % 2 else "bad### $$$ ") * 40 for k in range(40)] + [None]
    labels = [(k, k % 2) for k in range(40)] + [(0, 1), (None, 1), (1, None), (40, 1), (99, 0)]
    model = quality.train(
        documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")
    )
    assert model.probability(texts[1]) > 0.5 > model.probability(texts[0])
