"""Places of pattern matches with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose starts are summed up one by one; longer lists are summed block by block.
BLOCK = 128


def running_totals(lengths: Column) -> Column:
    """Totals of an INT array up to and including each entry, in time linear in its size."""

    def up_to(values: Column) -> Column:
        return F.aggregate(
            values,
            F.array(F.lit(0)),
            lambda done, x: F.array_append(done, F.element_at(done, -1) + x),
            lambda done: F.slice(done, 2, F.greatest(F.size(done) - 1, F.lit(0))),
        )

    def sums(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)),
    )
    before = F.concat(F.array(F.lit(0)), up_to(F.transform(blocks, sums)))
    long = F.flatten(F.zip_with(
        blocks, F.slice(before, 1, F.size(blocks)), lambda block, start: F.transform(up_to(block), lambda x: x + start)
    ))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).when(
        F.size(lengths) <= BLOCK, up_to(lengths)
    ).otherwise(long)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap: array of (start, stop, value), in code points.

    The text between the matches comes from ``split``, which walks the text as
    ``regexp_extract_all`` does; the lengths of both add up to the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    stops = running_totals(F.zip_with(found, between, lambda m, g: F.char_length(m) + F.char_length(g)))
    spans = F.zip_with(found, stops, lambda m, stop: F.struct(
        (stop - F.char_length(m)).alias("start"), stop.alias("stop"), m.alias("value")
    ))
    return F.when(text.rlike(pattern), spans).otherwise(
        F.array().cast("array<struct<start:int,stop:int,value:string>>")
    )


def listed(kinds: list[str], spans: Column) -> Column:
    """kind:start:stop, comma-joined, of spans (.., kind number, start, stop) already in order."""
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")
    )), ",")
