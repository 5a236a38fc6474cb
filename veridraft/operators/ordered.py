"""Ordered computations inside groups, safe for groups of any size.

A window over ``partitionBy(key)`` puts a whole group into one task. That is right for
ordinary groups and hopeless for one that holds a third of the table. So groups with more
than ``group_rows`` rows are cut into *chunks* by values that never decrease along the wanted
order, from coarse to fine: hours, their seconds, the timestamps themselves, blocks of ids.
Rows are shuffled by (key, all chunk values). Each level of chunks is chained by a window over
sums inside its parent chunk, so what meets in one task is bounded by the fan-out of a level
(3,600 seconds of an hour, say), also if all rows fall into one hour or on one timestamp. The
results are those of the plain window.

Finding the large groups is one aggregation over the key columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP_ROWS = 1_000_000


def _cut(df: DataFrame, keys: list[str], chunk: list[Column], group_rows: int) -> tuple[DataFrame, list[str]]:
    """Add chunk columns: NULL in ordinary groups, ``chunk`` in large ones."""
    names = [f"_chunk{i}" for i in range(len(chunk))]
    if not keys:
        return df.withColumns({**dict(zip(names, chunk)), "_large": F.lit(True)}), names
    large = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > group_rows)
        .select(*keys, F.lit(True).alias("_large"))
    )
    marked = df.join(large, keys, "left")
    return marked.withColumns({n: F.when(F.col("_large"), c) for n, c in zip(names, chunk)}), names


def running_sum(
    df: DataFrame,
    keys: list[str],
    order_by: list[Column],
    chunk: list[Column],
    values: dict[str, Column],
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add inclusive running sums (``values``: new column -> summed expression).

    ``chunk`` lists the levels of chunks, coarse to fine. Without keys everything is one
    group. ``df`` is read twice; hand in a table or a cheap plan.
    """
    work, chunks = _cut(df, keys, chunk, group_rows)
    work = work.withColumns({f"_v_{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()})
    within = (
        Window.partitionBy(*keys, *chunks)
        .orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    finest = work.where("_large").groupBy(*keys, *chunks).agg(
        *[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in values]
    )
    offsets = _chained(
        finest, keys, chunks,
        sums=[F.sum(f"_p_{n}").alias(f"_p_{n}") for n in values],
        before=lambda w: {f"_b_{n}": F.coalesce(F.sum(f"_p_{n}").over(w), F.lit(0)) for n in values},
        both=lambda coarse, fine: coarse + fine,
    )
    return (
        work.withColumns({n: F.sum(f"_v_{n}").over(within) for n in values})
        # same partitioning as the window: no further shuffle
        .join(offsets, [*keys, *chunks], "left")
        .withColumns({n: F.col(n) + F.coalesce(F.col(f"_b_{n}"), F.lit(0)) for n in values})
        .drop(*chunks, "_large", *[f"_v_{n}" for n in values], *[f"_b_{n}" for n in values])
    )


def _chained(finest: DataFrame, keys: list[str], chunks: list[str], sums, before, both) -> DataFrame:
    """What comes before each of the finest chunks: on every level the earlier chunks of the
    same parent, put together from coarse to fine."""
    earlier = (Window.unboundedPreceding, -1)
    levels = [finest]
    for depth in range(len(chunks) - 1, 0, -1):
        levels.append(levels[-1].groupBy(*keys, *chunks[:depth]).agg(*sums))
    done = None
    for depth, level in enumerate(reversed(levels), 1):
        window = Window.partitionBy(*keys, *chunks[: depth - 1]).orderBy(chunks[depth - 1]).rowsBetween(*earlier)
        names = before(window)
        found = level.select(*keys, *chunks[:depth], *[c.alias(n) for n, c in names.items()])
        if done is not None:
            coarse = done.withColumnsRenamed({n: f"{n}_up" for n in names})
            found = found.join(coarse, [*keys, *chunks[: depth - 1]]).withColumns(
                {n: both(F.col(f"{n}_up"), F.col(n)) for n in names}
            ).drop(*[f"{n}_up" for n in names])
        done = found
    return done


def position(
    df: DataFrame,
    keys: list[str],
    order_by: list[Column],
    chunk: list[Column],
    out: str,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """1-based position inside the group (inside everything if no keys)."""
    return running_sum(df, keys, order_by, chunk, {out: F.lit(1).cast("bigint")}, group_rows)


def last_before(
    df: DataFrame,
    keys: list[str],
    order_by: list[str],
    chunk: list[Column],
    value: str,
    out: str,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Add the last non-NULL ``value`` of the rows before this one in its group."""
    work, chunks = _cut(df, keys, chunk, group_rows)
    within = Window.partitionBy(*keys, *chunks).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    # newest value with its place in the order; the largest one is the last
    at = F.when(F.col(value).isNotNull(), F.struct(*order_by, F.col(value).alias("_value")))
    finest = work.where("_large").groupBy(*keys, *chunks).agg(F.max(at).alias("_last"))
    carried = _chained(
        finest, keys, chunks,
        sums=[F.max("_last").alias("_last")],
        before=lambda w: {"_carry": F.max("_last").over(w)},
        both=lambda coarse, fine: F.coalesce(fine, coarse),
    )
    return (
        work.withColumn(out, F.last(value, ignorenulls=True).over(within))
        .join(carried, [*keys, *chunks], "left")
        .withColumn(out, F.coalesce(out, "_carry._value"))
        .drop("_carry", "_large", *chunks)
    )


def time_chunks(ts: str = "ts", tie: str = "decision_id") -> list[Column]:
    """Levels for logs ordered by time and then by an integer id."""
    return [F.date_trunc("hour", F.col(ts)), F.date_trunc("second", F.col(ts)), F.col(ts), *block_chunks(tie)]


def block_chunks(position_column: str) -> list[Column]:
    """Levels for an integer position: blocks of 2^32, and of 65,536 in them."""
    at = F.col(position_column)
    return [F.floor(at / F.lit(1 << 32)).cast("bigint"), F.floor(at / F.lit(1 << 16)).cast("bigint")]
