from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import documents, odd_texts, words
from tests.llm.test_exact import expected
from tests.llm.test_packing import check_rows
from tests.llm.test_similar import plain_components
from veridraft.llm import pii, quality


def texts_of(rng):
    base = [words(rng, rng.randint(60, 300)) for _ in range(25)]
    near = []
    for t in base[:8]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    junk = ["bad### $$$ *** " * 30 + words(rng, 20) for _ in range(8)] + ["too short", "a b c " * 60]
    private = [words(rng, 60) + f" mail jo{k}@a.org or +1 (499) 555-650{k} now" for k in range(6)]
    return base + near + [base[0].upper(), base[1], base[1]] + junk + private + odd_texts(rng)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rng = random.Random(11)
    texts = texts_of(rng)
    ids = rng.sample(range(1000), len(texts))
    # Columns called like those the operators add must come through.
    documents(spark, texts, ids, extra=["kept", "found", "__text", "length"]).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if "###" in (t or "") else 1, 0) for i, t in zip(ids, texts) if len(t or "") > 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(zip(ids, texts))


def test_every_stage_against_plain_forms(spark, tables, tmp_path):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    columns, alive = docs.columns, dict(texts)

    def stage(k):
        nonlocal docs
        corpus_pipeline.STAGES[k][1](spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        return docs

    def same():
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in docs.collect()} == alive and docs.count() == len(alive)

    stage(0)
    counts = {i: quality.count_rules(t or "") for i, t in alive.items()}
    alive = {
        i: t for i, t in alive.items()
        if not quality.base_failed(counts[i][0], counts[i][4]) and model.probability(t) >= quality.KEEP_FROM
    }
    same()
    assert not any("###" in t for t in alive.values()) and len(alive) >= 40

    stage(1)
    keep = {k for _, k, _, _ in expected(list(alive), list(alive.values()))}
    alive = {i: t for i, t in alive.items() if i in keep}
    same()

    stage(2)
    ids = list(alive)
    root = plain_components(ids, list(alive.values()))
    alive = {i: alive[i] for i, r in zip(ids, root) if i == r}
    same()

    found = {r.doc_id: r.found for r in pii.find_personal_data(docs).collect()}
    stage(3)
    for i, t in alive.items():
        for s in sorted(found[i], key=lambda s: -s["start"]):
            t = t[: s["start"]] + f"[{pii.KINDS[s['kind']].upper()}]" + t[s["stop"] :]
        alive[i] = t
    same()
    assert sum("[EMAIL]" in t and "[PHONE]" in t for t in alive.values()) == 6
    assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    assert docs.where("kept <> 'x' OR found <> 'x'").count() == 0

    rows = stage(4).collect()
    order = {i: k for k, i in enumerate(alive)}
    moved = spark.createDataFrame(rows, docs.schema).replace(order, subset=["doc_id"]).collect()
    bins, least = check_rows(moved, list(alive.values()), 2048)
    assert bins <= least + 1

    whole = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(whole.select(*key).collect()) == sorted(docs.select(*key).collect())


def test_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_lists_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in names
