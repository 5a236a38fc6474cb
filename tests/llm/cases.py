"""Rows every operator must survive, and helpers for brute-force comparison."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def words(rng: random.Random, n: int) -> str:
    pieces = ["the", "on", "er", "tion", "ing", "Éa", "ü", "st", "re", "a", "X"]
    return " ".join("".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(n))


def odd_texts(rng: random.Random) -> list[str | None]:
    """Null, empty, blank, one character, ties, very long, many scripts."""
    return [
        None, "", " ", "\n\t\r\x0b\x0c ", "a", "A", "ß", " ", "two words", "Two Words", "x" * 40_000,
        "ab " * 20_000, "日本語 テキスト \U0001f600", "é İ K ſ", words(rng, 9000), "\x00 \x1c \x85  ",
    ]


def documents(spark, texts, ids=None, extra=None):
    """A documents table; ``extra`` adds string columns of the given names (clashing ones)."""
    ids = list(range(len(texts))) if ids is None else ids
    schema = T.StructType(DOCUMENTS.fields + [T.StructField(n, T.StringType()) for n in extra or []])
    rows = [
        (i, t, "en" if k % 3 else None, f"src{k % 4}" if k % 5 else None, None if t is None else len(t))
        + tuple("x" for _ in extra or [])
        for k, (i, t) in enumerate(zip(ids, texts, strict=True))
    ]
    return spark.createDataFrame(rows, schema)


def folder(df, tmp_path) -> str:
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)
