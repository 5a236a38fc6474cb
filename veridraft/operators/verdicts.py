"""Comparing claimed values with the winning source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridraft.functions.columns import mapped

# --- fixed values: units of amounts (L = lakh, Cr = crore) ---------------------------
UNITS = {
    "K": 10**3, "M": 10**6, "B": 10**9, "L": 10**5, "Cr": 10**7, "thousand": 10**3, "lakh": 10**5,
    "million": 10**6, "crore": 10**7, "billion": 10**9,
}
#: A number and its unit, which ends where a word ends; used for finding and for reading values.
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
UNIT = "|".join(UNITS)
AMOUNT = rf"({NUMBER})(?:\s?({UNIT})\b)?"
EXACT = "decimal(38,6)"


def parse_amount(text: Column) -> Column:
    """Exact number in a money or percent text: '₹20,640,000', '24.8M', '2.5 Cr', '99.5 %'.

    DECIMAL, since equality decides a verdict. Beyond 20 digits before the point: NULL.
    """
    number = F.regexp_replace(F.regexp_extract(text, AMOUNT, 1), ",", "").try_cast("decimal(26,6)")
    unit = F.coalesce(mapped(F.regexp_extract(text, AMOUNT, 2), UNITS), F.lit(1).cast("bigint"))
    return (number * unit.cast("decimal(11,0)")).cast(EXACT)


def parse_day(text: Column) -> Column:
    """Date in '22 Dec 2026', '22 December 2026', 'Dec 22, 2026' or '2026-12-22'."""
    short = F.regexp_replace(text, r"\b([A-Z][a-z]{2})[a-z]+\b", "$1")
    forms = ["d MMM yyyy", "MMM d, yyyy", "yyyy-MM-dd"]
    return F.coalesce(*[F.try_to_timestamp(short, F.lit(f)) for f in forms]).cast("date")


def claim_verdicts(claims: DataFrame, truths: DataFrame, keys: list[str]) -> DataFrame:
    """B09. claims(keys.., kind, amount, day, ...) against truths(keys.., kind, amount, day).

    Amounts are compared as DECIMAL(38, 6); the differences are DOUBLE, for display.
    ``truths`` has one row per key (see ``evidence.source_precedence``). No source:
    UNSUPPORTED. Different kind, or a value missing on either side: UNCERTAIN. Equal:
    SUPPORTED. Else CONTRADICTED, with the signed difference claim - truth as amount,
    percent of the truth, and days.
    """
    right = truths.select(
        *keys, F.col("kind").alias("_kind"), F.col("amount").cast(EXACT).alias("_amount"),
        F.col("day").alias("_day"), F.lit(True).alias("_found"),
    )
    both = claims.join(right, keys, "left")
    same_kind = F.col("kind") == F.col("_kind")
    delta = F.when(same_kind, F.col("amount").cast(EXACT) - F.col("_amount"))
    days = F.when(same_kind, F.datediff("day", "_day"))
    comparable = delta.isNotNull() | days.isNotNull()
    equal = (F.coalesce(delta == 0, F.lit(True))) & (F.coalesce(days, F.lit(0)) == 0)
    verdict = (
        F.when(F.col("_found").isNull(), "UNSUPPORTED")
        .when(~comparable, "UNCERTAIN")
        .when(equal, "SUPPORTED")
        .otherwise("CONTRADICTED")
    )
    return both.select(
        *claims.columns,
        verdict.alias("verdict"),
        delta.cast("double").alias("delta_amount"),
        F.when(F.col("_amount") != 0, delta.cast("double") / F.col("_amount").cast("double") * 100).alias("delta_percent"),
        days.alias("delta_days"),
    )
