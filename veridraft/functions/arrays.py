"""Array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def _exclusive(values: Column) -> Column:
    """Exclusive prefix sums plus the grand total at the end (quadratic: short arrays)."""
    return F.aggregate(
        values,
        F.array(F.lit(0).cast("bigint")),
        lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v),
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Lambdas of higher-order functions evaluate every outer expression again for every
    element; binding it to a lambda variable avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def start_offsets(lengths: Column) -> Column:
    """Exclusive prefix sums of a non-empty array of BIGINT.

    Built over blocks, so that an array of n entries costs about n * 256 + (n / 256)^2
    steps and a single huge text does not stall its task.
    """

    def blocks(values: Column) -> Column:
        count = F.ceil(F.size(values) / BLOCK).cast("int")
        return F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda b: _exclusive(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))),
        )

    def shifted(inner: Column) -> Column:
        bases = _exclusive(F.transform(inner, lambda sums: F.element_at(sums, -1)))
        return let(
            bases,
            lambda base: F.transform(
                inner,
                lambda sums, i: let(
                    F.get(base, i),
                    lambda b: F.transform(F.slice(sums, F.lit(1), F.size(sums) - 1), lambda s: s + b),
                ),
            ),
        )

    return F.flatten(let(lengths, lambda values: let(blocks(values), shifted)))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in array order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, p: acc + p)
