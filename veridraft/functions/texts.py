"""Text, file and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridraft import domains as D
from veridraft.functions.columns import or_default

MEBIBYTE = 1048576


def title_or_stem(title: Column, file_name: Column) -> Column:
    """A06. The title, else the file name without its last extension."""
    return or_default(title, F.regexp_replace(file_name, D.EXTENSION_PATTERN, ""))


def source_type(file_name: Column) -> Column:
    """A07. Case-sensitive on purpose."""
    return (
        F.when(F.endswith(file_name, F.lit(".pdf")), "Purchase Order")
        .when(F.endswith(file_name, F.lit(".xlsx")), "Commercial Schedule")
        .otherwise("Policy Doc")
    )


def default_authority(authority: Column, ord_: Column) -> Column:
    """A08. The first file of a set is the approved one unless stated."""
    return or_default(
        authority, F.when(ord_ == 0, "LATEST_APPROVED").otherwise("SIGNED_EXECUTED")
    )


def size_or_default(size: Column) -> Column:
    """A10. Whole-number sizes are kept, anything else becomes the default."""
    return F.coalesce(
        F.when(size.rlike(r"^\d+$"), size.try_cast("bigint")), F.lit(D.DEFAULT_SIZE_BYTES)
    ).cast("bigint")


def format_size(size_bytes: Column) -> Column:
    """A13. One-decimal megabytes; NULL stays NULL."""
    return F.when(size_bytes.isNotNull(), F.format_string("%.1f MB", size_bytes / F.lit(MEBIBYTE)))


def format_size_text(size: Column) -> Column:
    """A13. Text sizes pass through, numeric ones are formatted."""
    number = F.when(size.rlike(r"^\d+$"), size.try_cast("double"))
    return F.coalesce(format_size(number), size)


def upload_rejection(file_name: Column, size_bytes: Column) -> Column:
    """A11. NULL when accepted; a bad extension wins over a bad size."""
    name = F.lower(file_name)
    allowed = F.lit(False)
    for ext in D.UPLOAD_EXTENSIONS:
        allowed = allowed | F.endswith(name, F.lit(ext))
    return F.when(~allowed, D.BAD_EXTENSION).when(size_bytes > D.UPLOAD_LIMIT_BYTES, D.TOO_LARGE)


def format_location(location: Column) -> Column:
    """A24. Text of a tagged location; unknown and missing give NULL."""

    def text(field: str) -> Column:
        return location[field].cast("string")

    return (
        F.when(location["type"] == "pdf", F.concat(F.lit("Page "), text("page")))
        .when(
            location["type"] == "xlsx",
            F.concat(F.lit("Sheet "), text("sheet"), F.lit("!"), text("cell")),
        )
        .when(
            location["type"] == "docx",
            F.concat(
                F.lit("Para "), text("paragraph"), F.lit(" ("), text("char_start"),
                F.lit("-"), text("char_end"), F.lit(")"),
            ),
        )
        .when(
            location["type"] == "text",
            F.concat(F.lit("chars "), text("char_start"), F.lit(".."), text("char_end")),
        )
    )


def format_timestamp(iso_text: Column, with_time: bool = True) -> Column:
    """A26. ISO text as 'dd MMM, HH:mm' (or 'dd MMM yyyy'); other text passes through."""
    pattern = "dd MMM, HH:mm" if with_time else "dd MMM yyyy"
    return F.coalesce(F.date_format(F.try_to_timestamp(iso_text), pattern), iso_text)


def shown_version(document_version: Column, ai_version: Column) -> Column:
    """A27. Workspace header."""
    return or_default(document_version, ai_version)


def summary_version(ai_version: Column) -> Column:
    """A27. Summary bar."""
    return or_default(ai_version, D.DEFAULT_SUMMARY_VERSION)


def rank_text(order: Column) -> Column:
    """A28. At least two digits, never truncated."""
    digits = order.cast("string")
    return F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)


def split_paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """A57. Array of paragraphs; only really empty ones are dropped."""
    pieces = F.split(text, "\\Q" + separator + "\\E")
    return F.filter(pieces, lambda p: p != "")


def without_first(text: Column, needle: Column) -> Column:
    """A59. Text with the first literal occurrence of ``needle`` cut out, trimmed."""
    at = F.position(needle, text)
    cut = F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(needle)))
    return strip(F.when(at > 0, cut).otherwise(text))


def strip(text: Column) -> Column:
    """Trim every kind of white space on both ends, not only blanks."""
    # the look-behind keeps long runs of white space inside a text linear
    space = r"[\s\u00a0\ufeff]"
    return F.regexp_replace(text, f"^{space}+|(?<!{space}){space}+$", "")


def non_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))
