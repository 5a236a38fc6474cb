from __future__ import annotations

import random
from itertools import combinations, product

import pytest

from veridraft.llm import urls

PAGES = "page_id long, url string, html string"
LABELS = "doc_id long, quality int, toxic int"


def slow_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def slow_rule(host, path):
    fits = []
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), verdict, rule))
    return max(fits)[1:] if fits else None


ODD = [
    None, "", "no scheme", "://", "http://", "http://A.Example.COM", "http://example.com/en/", "http://example.com/en",
    "http://xexample.com/en/1", "https://www.example.com/en/x?y#z", "http://WWW.example.com/en/#/fr/", "http://a.net/es/",
    "http://net/fr/1", "http://b.net?/es/", "http://c.net#/fr/", "http://example.com:80/en/", "a://b://c/d", "http://É.com/é?x",
    "http://x.org/\n/y?\nq=1", "http://h.org/" + "a/" * 20_000, "http://www.example.com/EN/", "http://q.org/?a=1&b&c=2=3",
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(ODD)], PAGES)
    rows = {r.page_id: r for r in urls.filter_urls(df, urls.RULES, None).collect()}
    for i, url in enumerate(ODD):
        host, path = slow_host_path(url)
        rule = slow_rule(host, path)
        assert (rows[i].host, rows[i].path) == (host, path)
        assert (rows[i].verdict, rows[i].rule) == (rule or ("allow", None))


def test_tokens(spark):
    df = spark.createDataFrame([("https://M.cheap-pills.example.com/en/676/buy_now.html?ref=x&page=2#top",), (None,)], "u string")
    rows = [set(r[0]) for r in df.select(urls.url_tokens(df.u)).collect()]
    assert rows == [{"h:m", "h:cheap-pills", "h:example", "h:com", "p:en", "p:#", "p:buy", "p:now", "p:html", "q:ref", "q:page"}, set()]


def slow_rules(transactions, support, confidence, z):
    """All token sets with enough support, confidence and significance, minus those with a subset as sure."""
    n, bad = len(transactions), sum(b for _, b in transactions)
    found = {}
    for tokens in {frozenset(t) for t, _ in transactions}:
        for k in range(1, len(tokens) + 1):
            for items in combinations(sorted(tokens), k):
                if items not in found:
                    hits = [b for t, b in transactions if set(items) <= t]
                    found[items] = (sum(hits), len(hits))

    def low(share, c):
        return (share + z * z / (2 * c) - z * ((share * (1 - share) + z * z / (4 * c)) / c) ** 0.5) / (1 + z * z / c)

    rules = {
        i: b / c for i, (b, c) in found.items()
        if b >= support * n and b and b / c >= confidence and (b / c) / (bad / n) > 1 and low(b / c, c) > bad / n
    }
    return {
        i: c for i, c in rules.items()
        if not any(set(j) < set(i) and d >= c for j, d in rules.items())
    }


def labelled_pages(rng, n):
    hosts, parts, ends = ["good", "spam-farm", "mixed"], ["en", "fr", "x1"], ["", "?ref=1", "?page=2"]
    pages = [(i, f"http://{rng.choice(hosts)}.org/{rng.choice(parts)}/{i}{rng.choice(ends)}", None) for i in range(n)]

    def bad(url):
        return "spam-farm" in url or ("mixed" in url and "ref" in url and rng.random() < 0.9)

    return pages, [(i, 0 if bad(u) else 1, 0) for i, u, _ in pages if i % 3]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mining_and_matching_against_plain_search(spark, seed):
    pages, labels = labelled_pages(random.Random(seed), 400)
    labels += [(None, 0, 0), (5000, 0, 1), labels[0], (pages[0][0], None, None)]
    df, known = spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)
    mined = urls.mine_rules(df, known, 0.02, 0.6)
    tokens = {r.page_id: set(r.t) for r in df.select("page_id", urls.url_tokens(df.url).alias("t")).collect()}
    worst = {}
    for i, q, t in labels:
        if i in tokens:
            worst[i] = worst.get(i, False) or q == 0 or t == 1
    want = slow_rules([(tokens[i], b) for i, b in worst.items()], 0.02, 0.6, urls.SIGNIFICANCE)
    got = {tuple(r["items"]): r["confidence"] for r in mined.collect()}
    assert got == pytest.approx(want) and got
    rows = {r.page_id: r for r in urls.filter_urls(df, [], mined).collect()}
    for i, u, _ in pages:
        sure = [c for items, c in want.items() if set(items) <= tokens[i]]
        assert rows[i].verdict == ("block" if sure else "allow")
        assert rows[i].confidence == (pytest.approx(max(sure)) if sure else None)


def test_one_rule_at_every_size_of_the_table(spark):
    """The same pages three times over keep all rules, with the same confidence; what is added had the
    confidence before and lacked the evidence. Few or unrelated labels give no rules."""
    pages, labels = labelled_pages(random.Random(5), 600)
    more = [(i + 1000 * k, u, None) for k in range(3) for i, u, _ in pages]
    more_labels = [(i + 1000 * k, q, t) for k in range(3) for i, q, t in labels]
    small = urls.mine_rules(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS))
    large = urls.mine_rules(spark.createDataFrame(more, PAGES), spark.createDataFrame(more_labels, LABELS))
    small, large = ({tuple(r["items"]): r["confidence"] for r in x.collect()} for x in (small, large))
    assert small.items() <= large.items() and ("h:spam-farm",) in small
    loose = urls.mine_rules(
        spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS), significance=urls.SIGNIFICANCE / 3**0.5
    )
    assert large == {tuple(r["items"]): r["confidence"] for r in loose.collect()}
    few = urls.mine_rules(spark.createDataFrame(pages[:5], PAGES), spark.createDataFrame(labels[:4], LABELS))
    assert few.count() == 0
    rng = random.Random(6)
    unrelated = spark.createDataFrame([(i, rng.randrange(2), 0) for i, _, _ in pages], LABELS)
    assert urls.mine_rules(spark.createDataFrame(pages, PAGES), unrelated).count() == 0


def test_long_urls_are_mined_and_matched(spark):
    """Hundreds of tokens on a page, all pages alike: few of them are mined, and time stays small."""
    long = "http://h.org/" + "/".join(f"part{k}" for k in range(400))
    pages = [(i, long + (f"/bad?x{i}" if i % 4 == 0 else f"/good?x{i}"), None) for i in range(200)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(200)]
    df = spark.createDataFrame(pages, PAGES)
    mined = urls.mine_rules(df, spark.createDataFrame(labels, LABELS))
    assert ["p:bad"] in [r["items"] for r in mined.collect()]
    rows = {r.page_id: r.verdict for r in urls.filter_urls(df, [], mined).collect()}
    assert rows == {i: "block" if i % 4 == 0 else "allow" for i in range(200)}


def test_all_tokens_of_a_page_are_mined(spark):
    """Twelve tokens on many pages, each a little telling: rules hold all of them, also those that stand on the
    same pages as another, which do in its place on pages without it."""
    rng = random.Random(4)
    pages, labels = [], []
    for i in range(500):
        shown = [k for k in range(12) if rng.random() < 0.4]
        twins = ["aa11"] if 11 in shown else []
        pages.append((i, "http://h.org/" + "/".join([*(f"t{k:02}" for k in shown), *twins]), None))
        labels.append((i, int(rng.random() > 0.1 + 0.07 * len(shown) + 0.4 * (10 in shown and 11 in shown)), 0))
    df = spark.createDataFrame(pages, PAGES)
    mined = urls.mine_rules(df, spark.createDataFrame(labels, LABELS), 0.02, 0.6, 2.0).collect()
    tokens = [set(r.t) for r in df.select(urls.url_tokens(df.url).alias("t")).collect()]
    want = slow_rules([(t, q == 0) for t, (_, q, _) in zip(tokens, labels)], 0.02, 0.6, 2.0)
    got = {tuple(sorted(x)): r["confidence"] for r in mined for x in product(*r["same"])}
    assert got == pytest.approx(want)
    assert {t for items in want for t in items} >= {f"p:t{k:02}" for k in range(12)} | {"p:aa11"}
    one = spark.createDataFrame([(0, "http://x.org/t10/aa11", None), (1, "http://x.org/t10/t11", None)], PAGES)
    rules = urls.mine_rules(df, spark.createDataFrame(labels, LABELS), 0.02, 0.6, 2.0)
    assert [r.verdict for r in urls.filter_urls(one, [], rules).collect()] == ["block"] * 2


def test_no_rows_no_labels_and_clashing_columns(spark):
    none = spark.createDataFrame([], PAGES)
    assert urls.mine_rules(none, spark.createDataFrame([], LABELS)) is None
    assert urls.filter_urls(none, urls.RULES, None).count() == 0
    df = spark.createDataFrame([(1, "http://a.com/", "x", "y")] * 2, "page_id long, url string, host string, verdict string")
    rows = urls.filter_urls(df, urls.RULES, None, columns=df.columns).collect()
    assert [(r.host, r.verdict, r.url) for r in rows] == [("a.com", "allow", "http://a.com/")] * 2
    labels = spark.createDataFrame([(1, 1, 0)] * 3, LABELS)
    many = spark.createDataFrame([(1, "http://a.com/", None)] * 30, PAGES)
    assert urls.mine_rules(many, labels).count() == 0  # no bad page at all
