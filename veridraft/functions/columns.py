"""Small column helpers shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridraft import domains as D


def truthy(value: Column) -> Column:
    """The text, with '' read as missing."""
    return F.nullif(value, F.lit(""))


def or_default(value: Column, default) -> Column:
    """The text, or ``default`` where it is missing or empty."""
    return F.coalesce(truthy(value), default if isinstance(default, Column) else F.lit(default))


def mapped(value: Column, mapping: dict, otherwise=None) -> Column:
    """CASE over a fixed mapping: stays inside code generation, no join."""
    keys = [k for k in mapping if k is not None]
    case = reduce(
        lambda acc, k: acc.when(value == k, F.lit(mapping[k])),
        keys[1:],
        F.when(value == keys[0], F.lit(mapping[keys[0]])),
    )
    default = mapping.get(None, otherwise)
    return case if default is None else case.otherwise(F.lit(default))


def audit_key(audit_id: Column) -> Column:
    """Audit ids compare case-insensitively."""
    return F.lower(audit_id)


def is_active(status: Column) -> Column:
    """The flag still counts against the score."""
    return status.isin(*D.ACTIVE_FLAG_STATUSES)
