"""Canonical text and claim extraction (B04, B05). Everything here runs inside the scan
stage: one row in, its sentences or claims out, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridraft.functions.arrays import start_offsets
from veridraft.operators.verdicts import NUMBER, UNIT

#: The rest of a tag after its name: a quote counts after ``=`` only, and a ``>`` inside it ends
#: nothing. What is never closed goes on to the end of the text, so no place is scanned twice.
TAG_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+)*+(?:>|\z)"""
TAG = rf"<(?:/?[a-zA-Z]|[!?]){TAG_REST}"
# --- fixed values: elements without text, and those that end a sentence ---------------
NO_TEXT = ("script", "style")
BLOCKS = (
    "address|article|aside|blockquote|br|caption|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header"
    "|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
)
#: Comments and elements without text; closed or up to the end.
HIDDEN = r"<!--(?:.*?-->|.*)|" + "|".join(rf"<{e}\b{TAG_REST}(?:.*?</{e}\s*+>|.*)" for e in NO_TEXT)
BLOCK_TAG = rf"</?(?:{BLOCKS})\b{TAG_REST}"
#: Stands for the end of a block; in plain text too it separates paragraphs.
BREAK = "\u2029"
#: (pattern, replacement), one after another: each alternation walks the text tag by tag.
MARKUP = (
    (rf"(?is)(?:{HIDDEN})|({TAG})", " $1"),
    (rf"(?is)({BLOCK_TAG})|{TAG}", " $1"),
    (rf"(?is){BLOCK_TAG}", BREAK),
)
#: Named entities and their characters, without those for the ampersand, which come last.
ENTITIES = {f"&{n}": c for n, c in html5.items() if n.endswith(";") and c != "&"} | {"&nbsp;": " "}
AMPERSANDS = tuple(f"&{n}" for n, c in html5.items() if n.endswith(";") and c == "&")
ENTITY = "&[a-zA-Z][a-zA-Z0-9]{1,31};"
# --- fixed values: what counts as a verifiable value -----------------------------------
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
#: A run before the @ is taken whole and only where it begins: linear in the text, without a
#: bound on its length.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._+-]))[A-Za-z0-9._+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
CLAIM_PATTERNS = (
    ("COMMERCIAL_VALUE", rf"(?:[$€£₹]\s?|\b(?:USD|EUR|GBP|INR) ){NUMBER}(?:\s?(?:{UNIT})\b)?"),
    (
        "DELIVERY_DATE",
        rf"\b[0-9]{{1,2}} (?:{MONTHS})[a-z]* [0-9]{{4}}\b|\b(?:{MONTHS})[a-z]* [0-9]{{1,2}}, [0-9]{{4}}\b"
        r"|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    ),
    ("SLA_GUARANTEE", r"\b[0-9]+(?:\.[0-9]+)?\s?(?:%|percent\b)"),
    (
        "PII_SECURITY",
        EMAIL
        + r"|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"
        r"|\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
        r"|\b[0-9]{16}\b",
    ),
)
ENTITY_NUMBER = "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
SENTENCE_END = f"(?<=[.!?]) |{BREAK}"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip_markup(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags out, block ends marked, entities decoded.

    Linear in the page: every pattern consumes what it looks at. An element, comment, quote or
    tag that is never closed goes on to the end, as in a browser.
    """
    text = html
    for pattern, by in MARKUP:
        text = F.regexp_replace(text, pattern, by)
    return once(once(text, numeric_entities), named_entities)


def named_entities(text: Column) -> Column:
    """Decode ``&eacute;`` and the like; unknown names stay as they are."""
    # one literal, as thousands of them take seconds to plan
    table = F.str_to_map(F.lit("\u0002".join(f"{e}\u0001{c}" for e, c in ENTITIES.items())), F.lit("\u0002"), F.lit("\u0001"))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    decoded = F.aggregate(found, text, lambda t, e: F.replace(t, e, F.coalesce(F.try_element_at(table, e), e)))
    for entity in AMPERSANDS:
        decoded = F.replace(decoded, F.lit(entity), F.lit("&"))
    return F.when(text.contains("&"), decoded).otherwise(text)


def numeric_entities(text: Column) -> Column:
    """Decode ``&#8217;`` and ``&#x20AC;``; numbers that are no character stay as they are."""
    code = lambda e: F.when(
        e.rlike("^&#[xX]"), F.conv(F.regexp_extract(e, "([0-9a-fA-F]+);", 1), 16, 10)
    ).otherwise(F.regexp_extract(e, "([0-9]+);", 1)).try_cast("bigint")
    valid = lambda n: (n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF))
    # UTF-32 bytes of the number, read as text
    char = lambda e: F.when(
        valid(code(e)), F.decode(F.unhex(F.lpad(F.hex(code(e)), 8, "0")), "UTF-32")
    ).otherwise(e)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY_NUMBER), F.lit(0)))
    return F.when(text.contains("&#"), F.aggregate(found, text, lambda t, e: F.replace(t, e, char(e)))).otherwise(text)


def normalise_space(text: Column) -> Column:
    """Runs of white space become one blank, those with a ``BREAK`` one of these. Plain byte
    replacements do most of the work; the patterns only meet runs."""
    for space in "\t\n\u000b\f\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    def broken(text: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(text, f" ?{BREAK} ?", BREAK), f"{BREAK}{{2,}}", BREAK)
        marked = F.regexp_replace(marked, rf"^{BREAK}|{BREAK}\z", "")
        return F.when(F.contains(text, F.lit(BREAK)), marked).otherwise(text)

    return F.trim(once(F.regexp_replace(text, " {2,}", " "), broken))


def canonical_stream(documents: DataFrame, key: str, text: Column) -> DataFrame:
    """B04. Sentence rows of the canonical text with [char_start, char_end) offsets.

    A sentence ends at . ! ? followed by a blank, or with its block. Offsets count code points
    of the canonical (space-normalised) text, in which one character separates sentences.
    """
    parts = F.split("_text", SENTENCE_END)
    starts = start_offsets(F.transform(F.col("_parts"), lambda s: (F.length(s) + 1).cast("bigint")))
    return (
        # a filter on the text would be pushed down and compute it twice; no parts give no rows
        documents.select(key, normalise_space(text).alias("_text"))
        .select(key, F.when(F.col("_text") != "", parts).alias("_parts"))
        .select(key, F.posexplode(F.arrays_zip(F.col("_parts").alias("s"), starts.alias("b"))).alias("i", "z"))
        .select(
            key,
            (F.col("i") + 1).alias("sentence_no"),
            F.col("z.s").alias("sentence"),
            F.col("z.b").cast("bigint").alias("char_start"),
            (F.col("z.b") + F.length("z.s")).cast("bigint").alias("char_end"),
        )
    )


def _tagged(category: str, pattern: str) -> Column:
    values = F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0))
    return F.transform(values, lambda v: F.struct(F.lit(category).alias("category"), v.alias("value")))


def extract_claims(sentences: DataFrame, key: str) -> DataFrame:
    """B05. One row per verifiable value in a sentence, with its category.

    Sentences without any digit or @ skip the patterns.
    """
    found = F.concat(*[_tagged(category, pattern) for category, pattern in CLAIM_PATTERNS])
    return (
        sentences.where(F.col("sentence").rlike("[0-9@]"))
        .select(key, "sentence_no", "sentence", F.posexplode(found).alias("i", "c"))
        .select(
            key, "sentence_no", (F.col("i") + 1).alias("value_no"), "c.category", "c.value", "sentence"
        )
    )
