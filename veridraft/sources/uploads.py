"""Uploaded files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridraft import domains as D
from veridraft.functions import texts
from veridraft.functions.columns import or_default


def validate_uploads(files: DataFrame, validate_multi: bool = True) -> tuple[DataFrame, DataFrame]:
    """A11. files(name, size_bytes, [batch_size]) -> accepted, rejected(reason).

    The multi-file path of the original upload control skips the check;
    ``validate_multi=False`` reproduces that for rows with ``batch_size`` > 1.
    """
    reason = texts.upload_rejection(F.col("name"), F.col("size_bytes"))
    if not validate_multi:
        reason = F.when(F.col("batch_size") <= 1, reason)
    judged = files.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def read_contents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, content) of the files below ``path``. Spark's file sources skip empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content")


def upload_manifest(files: DataFrame, contents: DataFrame, mime_types: dict[str, str] | None = None) -> DataFrame:
    """A12. One row per listed file with its real SHA-256 digest.

    files(path, length) is the listing, contents(path, content) what could be read: a file of
    length 0 needs no content and has the digest of nothing. Any other file without content
    has a NULL id and hash. The name is the last path step; ``mime_types`` maps extensions.
    """
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    mime = F.lit(None).cast("string")
    if mime_types:
        table = F.create_map(*[F.lit(x) for kv in mime_types.items() for x in kv])
        mime = table[ext]
    # digests before the join, so that contents are not shuffled
    read = contents.select("path", F.sha2("content", 256).alias("_digest"))
    digest = F.when(F.col("length") == 0, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("_digest"))
    return files.join(read, "path", "left").select(
        F.concat(F.lit("DOC-"), F.substring(digest, 1, 16)).alias("id"),
        name.alias("filename"),
        F.col("length").cast("bigint").alias("size_bytes"),
        or_default(mime, D.DEFAULT_MIME).alias("mime_type"),
        F.concat(F.lit("sha256:"), digest).alias("hash"),
    )


def apply_source_edits(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """A14. sources(source_id, name, authority, size_bytes), edits(op, source_id, name,
    authority, size_bytes) with op ADD / REMOVE / AUTHORITY.

    Added files are LATEST_APPROVED; removed ids go; the last authority edit must be unique
    per id.
    """
    added = edits.where("op = 'ADD'").select(
        "source_id", "name", F.lit("LATEST_APPROVED").alias("authority"), "size_bytes"
    )
    removed = edits.where("op = 'REMOVE'").select("source_id")
    changed = edits.where("op = 'AUTHORITY'").select(
        "source_id", F.col("authority").alias("_new_authority")
    )
    return (
        sources.select("source_id", "name", "authority", "size_bytes")
        .unionByName(added)
        .join(removed, "source_id", "left_anti")
        .join(changed, "source_id", "left")
        .withColumn("authority", F.coalesce("_new_authority", "authority"))
        .drop("_new_authority")
    )
