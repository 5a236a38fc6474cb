"""Exact duplicates: a tree that merges sorted runs of digests.

Every document gets a run number from its id. A run holds one entry per digest: the
identifier that stays and the number of rows. Runs are merged ``fan_in`` at a time in rounds
(64 -> 16 -> 4 -> 1); each merge keeps the winning identifier of every digest. An entry is
(SHA-256, XXH64, length): a merge joins entries only if all three agree. A text that a third
of all rows share never meets in one task: a task sees it once for every run at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridraft.llm.common import ascii_lower
from veridraft.session import materialise

ENTRY = ["__sha", "__check", "__bytes"]


def merged(runs: DataFrame, *keys) -> DataFrame:
    """Merge runs that agree in ``keys``: the winner and the row count of every entry."""
    return runs.groupBy(*keys, *ENTRY).agg(F.max("__best").alias("__best"), F.sum("__size").alias("__size"))


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    columns: list[str] | None = None,
    keep: str = "largest",
    runs: int = 64,
    fan_in: int = 4,
) -> DataFrame:
    """One row per document: ``columns`` (default: the id) and what became of it.

    Adds keep_id, group_size, kept, text_sha256 (of the text with A-Z in lower case) and
    drops columns of those names from ``columns``. ``keep`` is "largest" or "smallest".

    A null text counts as empty. A null id loses against any other; of rows with the same
    id and text one stays. No rows give no rows.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    carried = [c for c in columns or [doc_id] if c not in added]
    body = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    # Written once: the row number must not change when a lost task runs again.
    rows = materialise(
        docs.select(*carried, F.col(doc_id).alias("__id"), body.alias("__text")).select(
            *carried,
            "__id",
            F.monotonically_increasing_id().alias("__row"),
            F.pmod(F.xxhash64("__id", F.monotonically_increasing_id()), F.lit(runs)).alias("__run"),
            F.unhex(F.sha2("__text", 256)).alias("__sha"),
            F.xxhash64("__text").alias("__check"),
            F.octet_length("__text").alias("__bytes"),
        ),
        "exact-rows",
    )
    # The largest struct wins: for the smallest id its complement is compared (nulls lose both ways).
    rank = F.col("__id") if keep == "largest" else F.expr("~__id")
    best = F.struct(rank.alias("rank"), F.col("__row").alias("row"), F.col("__id").alias("id"))
    first = rows.select("__run", *ENTRY, best.alias("__best"), F.lit(1).cast("long").alias("__size"))
    first = merged(first, "__run")

    top, left = first, runs
    while left > 1:
        top = merged(top, F.floor(F.col("__run") / fan_in).alias("__run"))
        left = -(-left // fan_in)
    totals = top.select(*ENTRY, F.col("__best").alias("__top"), F.col("__size").alias("__total"))
    # Down again: an entry occurs once per run, and a run's rows lie apart from those of other runs.
    answers = first.select("__run", *ENTRY).join(totals, ENTRY)
    return rows.join(materialise(answers, "exact-answers"), ["__run", *ENTRY]).select(
        *carried,
        F.col("__top.id").alias("keep_id"),
        F.col("__total").alias("group_size"),
        (F.col("__row") == F.col("__top.row")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def op8_exact_dedup(spark, folder: str) -> DataFrame:
    from veridraft.llm.common import table

    return exact_groups(table(spark, folder, "documents"))


OP8_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
