"""Small helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows per Arrow batch: 1,000 texts, so that a batch of long texts stays small.
BATCH_ROWS = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; every query starts here, so the Arrow batch size is set here as well."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ``lower`` where the text is pure ASCII, as it is the faster one."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def map_batches(
    df: DataFrame,
    function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    fields: Sequence[tuple[str, T.DataType]],
) -> DataFrame:
    """``mapInArrow`` with the result's columns as (name, type)."""
    return df.mapInArrow(function, T.StructType([T.StructField(n, t) for n, t in fields]))


def add_columns(
    df: DataFrame,
    text: str,
    added: Sequence[tuple[str, T.DataType, pa.DataType]],
    function: Callable[[list[str]], Sequence],
    keep_text: bool = True,
) -> DataFrame:
    """Append columns computed from whole texts, batch by batch; a null text counts as empty.

    ``function`` gets a batch's texts and returns one sequence for each added column. All
    other columns pass through unchanged; a column with an added name is replaced.
    """
    names = {n for n, _, _ in added}
    carried = [f for f in df.schema.fields if f.name not in names and (keep_text or f.name != text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            new = function(texts)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in carried]
            columns += [pa.array(x, type=t) for x, (_, _, t) in zip(new, added, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in carried] + [n for n, _, _ in added])

    return df.mapInArrow(run, T.StructType(carried + [T.StructField(n, t) for n, t, _ in added]))
