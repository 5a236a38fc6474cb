"""URL filters: fixed host and path rules, and association rules mined from labelled pages.

FP-growth finds combinations of URL tokens (host labels, path parts, names of parameters)
that labelled pages share; those that come with the label "bad" become rules. A rule needs the
same share of the labelled pages and the same confidence at every size of the table, and it
has to be significant: the lower end of its confidence interval lies above the share of bad
pages. Rules that need more tokens than another rule without being surer are pruned. An
inverted index from each rule's rarest token finds the rules a URL could meet; the rest of
their tokens is then checked.

All tokens of a page take part. Only those that no rule can need stay out of mining, and tokens
that stand on the same pages are mined as one; both leave the rules as they are.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridraft.llm.common import UPPER, LOWER, table
from veridraft.session import materialise

#: Fixed rules: (verdict, host and path). A rule fits its host and all subdomains.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Share of labelled pages that must show a combination, and share of those that must be bad.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: Half-width of the confidence interval (Wilson) in standard deviations.
SIGNIFICANCE = 4.0
BAD = "=bad"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    return (
        F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    )


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, marked by where they stand; numbers are one token."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    marked = lambda mark, parts: F.transform(parts, lambda x: F.concat(F.lit(mark), x))
    parts = F.transform(F.split(path, r"[/._-]"), lambda x: F.when(x.rlike("^[0-9]+$"), "#").otherwise(x))
    names = F.transform(F.split(query, "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    every = F.concat(marked("h:", F.split(host, "[.]")), marked("p:", parts), marked("q:", names))
    return F.coalesce(
        F.array_distinct(F.filter(every, lambda x: F.char_length(x) > 2)), F.array().cast("array<string>")
    )


def wilson_low(share: Column, n: Column, z: float) -> Column:
    """Lower end of the confidence interval of a share seen in n cases."""
    spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (share + z * z / (2 * n) - spread) / (1 + z * z / n)


def mined_items(rows: DataFrame, pages: int, bad: float, support: float, significance: float) -> DataFrame:
    """(token, item) of (page, bad, tokens): the tokens that a rule can hold. Tokens of exactly the same pages
    make the same rules, so one of them, the first by name, is the item of all.

    A rule's bad pages show each of its tokens. So a token on too few bad pages for the support, or
    for significance if no other page had it, is in no rule; one on all pages adds nothing to a rule.
    """
    each = rows.select("page", "bad", F.explode("tokens").alias("token"))
    cover = [F.sum(F.xxhash64("page").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("page", F.lit(1)))]
    found = each.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), *(c.alias(f"c{i}") for i, c in enumerate(cover))
    )
    surest = F.col("bad") / (F.col("bad") + significance * significance)  # ``wilson_low`` of a share of 1
    found = found.where(
        (F.col("bad") >= math.ceil(support * pages)) & (surest > bad - 1e-9) & (F.col("n") < pages)
    )
    same = found.groupBy("n", "bad", "c0", "c1").agg(F.min("token").alias("item"), F.collect_list("token").alias("token"))
    return same.select(F.explode("token").alias("token"), "item")


def mine_rules(
    pages: DataFrame,
    labels: DataFrame,
    support: float = MIN_SUPPORT,
    confidence: float = MIN_CONFIDENCE,
    significance: float = SIGNIFICANCE,
) -> DataFrame | None:
    """(items, confidence, support, same) of pruned rules "these tokens, so bad"; None without labelled pages.

    ``same`` has, for each item, the tokens that stand on the same pages, itself included: any of
    them does in its place. All labelled pages and all their tokens count; a page is bad if a label of its id says poor quality or toxic.
    Support, confidence and significance mean the same at every size of the table.
    """
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce(bad, F.lit(False))).alias("bad"))
    rows = pages.select("page_id", url_tokens(F.col("url")).alias("tokens")).join(
        known, F.col("page_id") == F.col("doc_id")
    )
    rows = materialise(rows.select("bad", "tokens", F.monotonically_increasing_id().alias("page")), "urls-labelled")
    totals = rows.agg(F.count("*").alias("n"), F.avg(F.col("bad").cast("double")).alias("bad")).first()
    if not totals.n:
        return None
    bad_item = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    known = materialise(mined_items(rows, totals.n, totals.bad, support, significance), "urls-tokens")
    shown = rows.select("page", F.explode("tokens").alias("token")).join(known, "token")
    shown = shown.groupBy("page").agg(F.collect_set("item").alias("shown"))
    # Pages without such tokens show no combination, but they are pages.
    shown = rows.select("page", "bad").join(shown, "page", "left")
    none = F.array().cast("array<string>")
    items = materialise(shown.select(F.concat(F.coalesce("shown", none), bad_item).alias("items")), "urls-items")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.array_contains("consequent", BAD) & (F.col("lift") > 1))
    shown = F.col("support") * totals.n / F.col("confidence")  # pages with the rule's tokens, bad or not
    rules = rules.where(wilson_low(F.col("confidence"), shown, significance) > totals.bad)
    rules = materialise(rules.select(
        F.array_sort("antecedent").alias("items"), "confidence", "support"
    ), "urls-rules")
    groups = known.groupBy("item").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    each = pruned_rules(rules).select("*", F.posexplode("items").alias("at", "item")).join(groups, "item")
    same = F.array_sort(F.collect_list(F.struct("at", "tokens")))["tokens"]
    return each.groupBy("items", "confidence", "support").agg(same.alias("same"))


def pruned_rules(rules: DataFrame) -> DataFrame:
    """Rules without those that have a subset, which has all their pages, that is as sure.

    Each subset of a rule, all of which were mined as well, is looked up by its items.
    """
    subsets = rules.withColumn("part", F.explode(_subsets(F.col("items")))).where(F.size("part") < F.size("items"))
    sure = rules.select(F.col("items").alias("part"), F.col("confidence").alias("sure"))
    beaten = subsets.join(sure, "part").where("sure >= confidence").select("items").distinct()
    return rules.join(beaten, "items", "left_anti")


def _subsets(items: Column) -> Column:
    """All subsets of a sorted array but the empty one, each sorted."""
    numbers = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(items)) - 1)
    return F.transform(numbers, lambda m: F.filter(
        items, lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(1) == 1
    ))


def rules_by_token(rules: DataFrame) -> DataFrame:
    """(token, same, confidence): each rule under its rarest item among rules, ties by name, and under
    all tokens that do in its place."""
    each = rules.select("same", "confidence", F.posexplode("items").alias("at", "item"))
    often = each.groupBy("item").agg(F.count("*").alias("n"))
    least = each.join(often, "item").groupBy("same", "confidence").agg(F.min(F.struct("n", "item", "at"))["at"].alias("at"))
    return least.select(F.explode(F.get("same", F.col("at"))).alias("token"), "same", "confidence")


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame | None, columns: list[str] | None = None
) -> DataFrame:
    """One row per page: ``columns`` (default: page_id), host, path, rule, verdict, and the
    confidence of the mined rule that blocked it, if one did. Added names replace carried ones.

    The longest fixed rule decides; without one a page is blocked if a mined rule matches and
    allowed otherwise. A null URL, or one without ``://``, has an empty host and path and no
    rule. Equal URLs get equal verdicts; of mined rules that match, the surest one counts. URLs
    of any length are read whole. No rows give no rows.
    """
    added = ["host", "path", "rule", "verdict", "confidence"]
    carried = [c for c in columns or ["page_id"] if c not in added]
    rows = pages.select(*carried, F.col("url").alias("__url"))
    if mined is not None:
        # Only distinct URLs look for rules: each meets those under one of its tokens.
        urls = rows.select("__url").where("__url IS NOT NULL").distinct().withColumn("__tokens", url_tokens(F.col("__url")))
        met = urls.withColumn("token", F.explode("__tokens")).join(rules_by_token(mined), "token").where(
            F.forall("same", lambda tokens: F.arrays_overlap(tokens, F.col("__tokens")))
        )
        met = met.groupBy("__url").agg(F.max("confidence").alias("__sure"))
        rows = rows.join(met, "__url", "left")
    else:
        rows = rows.withColumn("__sure", F.lit(None).cast("double"))
    host, path = host_and_path(F.col("__url"))
    rows = rows.select(
        *carried, host.alias("host"), path.alias("path"), fitting_rule(host, path, rules).alias("__rule"), "__sure"
    )
    learnt = F.when(F.col("__sure").isNotNull(), "block").otherwise("allow")
    return rows.select(
        *carried, "host", "path", F.col("__rule.rule").alias("rule"),
        F.coalesce("__rule.verdict", learnt).alias("verdict"),
        F.when(F.col("__rule").isNull(), F.col("__sure")).alias("confidence"),
    )


def op6_url_filter(spark, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return filter_urls(pages, RULES, mine_rules(pages, table(spark, folder, "labels")))
