"""Paths for large groups, checked against plain windows, builtins or brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridraft.functions.arrays import BLOCK, start_offsets
from tests.scans import shuffled_bytes
from veridraft.operators import activity, canonical, evidence, ordered, paragraphs, passports, retrieval, scoring, stages


@pytest.fixture(scope="module")
def skewed_log(spark):
    """One key holds about half of the rows; ties in time are broken by id."""
    rng = random.Random(7)
    start = datetime(2026, 1, 1)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}"
        value = rng.choice([None, rng.randrange(-5, 6)])
        rows.append((i, key, start + timedelta(minutes=rng.randrange(6000)), value))
    return spark.createDataFrame(rows, "id bigint, k string, ts timestamp, v int").cache()


@pytest.mark.parametrize("group_rows", [0, 100, 10**9])
def test_running_sum_equals_plain_window(skewed_log, group_rows):
    order = [F.col("ts"), F.col("id")]
    got = ordered.running_sum(skewed_log, ["k"], order, ordered.time_chunks("ts", "id"), {"s": F.col("v")}, group_rows)
    plain = F.sum(F.coalesce("v", F.lit(0))).over(
        Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    want = skewed_log.withColumn("s", plain)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("group_rows", [0, 100, 10**9])
def test_last_before_equals_plain_window(skewed_log, group_rows):
    got = ordered.last_before(skewed_log, ["k"], ["ts", "id"], ordered.time_chunks("ts", "id"), "v", "p", group_rows)
    plain = F.last("v", ignorenulls=True).over(
        Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    )
    want = skewed_log.withColumn("p", plain)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_tasks_stay_small_as_data_grows(spark):
    """A stage that chains sorts holds many times what it reads, so a task reads a few MB, not a share of the input."""
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = spark.range(3_000_000).selectExpr("xxhash64(id) AS k", "xxhash64(id, 1) AS at", "id")
        placed = ordered.position(rows, ["k"], [F.col("at")], ordered.block_chunks("at"), "p", 0)
        assert placed.rdd.getNumPartitions() >= 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_group_with_one_timestamp(spark):
    """A bulk import: one key holds all rows, at one time."""
    log = spark.range(5000).selectExpr("id * 40 AS id", "'hot' AS k", "TIMESTAMP '2026-01-01' AS ts", "CAST(id % 7 AS INT) AS v")
    log = log.repartition(5)
    got = ordered.running_sum(log, ["k"], [F.col("ts"), F.col("id")], ordered.time_chunks("ts", "id"), {"s": F.col("v")}, 100)
    assert [r.s for r in got.orderBy("id").collect()] == list(itertools.accumulate(i % 7 for i in range(5000)))
    got = ordered.last_before(log.withColumn("v", F.expr("nullif(v, 3)")), ["k"], ["ts", "id"], ordered.time_chunks("ts", "id"), "v", "p", 100)
    want = [None] + [2 if i % 7 == 3 else i % 7 for i in range(4999)]
    assert [r.p for r in got.orderBy("id").collect()] == want


def test_sums_beyond_an_int(spark):
    """Four flags of -2 * 10^9: the running score and the clamped one."""
    flags = spark.createDataFrame(
        [("A", i, f"F{i}", "HIGH", "PENDING", -2_000_000_000) for i in range(4)],
        "audit_id string, ord int, flag_id string, severity string, status string, impact_score int",
    )
    audits = spark.createDataFrame([("A", 1)], "audit_id string, seq bigint")
    steps = scoring.waterfall(audits, flags).orderBy("step").collect()
    assert [r.score_after for r in steps] == [100 - 2_000_000_000 * i for i in range(5)]
    assert [r.final_score for r in steps] == [None] * 4 + [0]
    assert scoring.rescore(audits, flags).first().trust_score == 0


def test_global_position(skewed_log):
    got = ordered.position(skewed_log, [], [F.desc("id")], [-F.floor(F.col("id") / 100)], "p").collect()
    assert all(r.p == 3000 - r.id for r in got)


def test_sessions_equal_builtin(skewed_log):
    log = skewed_log.withColumnRenamed("k", "reviewed_by")
    got = activity.session_activity(log, 600, ("reviewed_by",)).select("reviewed_by", "session_start", "decisions")
    want = log.groupBy(F.session_window("ts", "600 seconds").alias("w"), "reviewed_by").agg(
        F.count(F.lit(1)).alias("decisions")
    ).select("reviewed_by", F.col("w.start").alias("session_start"), "decisions")
    # the builtin joins sessions that touch exactly; compare on a log without such gaps
    micros = {}
    for r in log.select("reviewed_by", "ts").collect():
        micros.setdefault(r.reviewed_by, []).append(r.ts)
    touching = any(
        b - a == timedelta(seconds=600) for v in micros.values() for a, b in zip(sorted(v), sorted(v)[1:])
    )
    if touching:
        log = log.withColumn("ts", F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, 0, CAST(id % 59 AS DOUBLE) / 100)"))
        got = activity.session_activity(log, 600, ("reviewed_by",)).select("reviewed_by", "session_start", "decisions")
        want = log.groupBy(F.session_window("ts", "600 seconds").alias("w"), "reviewed_by").agg(
            F.count(F.lit(1)).alias("decisions")
        ).select("reviewed_by", F.col("w.start").alias("session_start"), "decisions")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


# -- claim matching --------------------------------------------------------------------


def brute_match(paras, flags):
    out = {}
    for key, no, text in paras:
        for _key, _ord, flag_id, claim in sorted((f for f in flags if f[0] == key), key=lambda f: f[1]):
            if claim is not None and claim.lower()[:30] in text.lower():
                out[(key, no)] = flag_id
                break
    return out


@pytest.fixture(scope="module")
def matching_case():
    rng = random.Random(3)
    words = ["pay", "Total", "fee", "ΔÉß", "a.b*c", "(x)", "$1", "\\d", "naïve", "😀ok", "30 days", "x\ny"]
    paras, flags = [], []
    for audit in ("A", "B", "C"):
        texts = [" ".join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(40)]
        paras += [(audit, i + 1, t) for i, t in enumerate(texts)]
        for i in range({"A": 30, "B": 3, "C": 60}[audit]):
            source = rng.choice(texts)
            at = rng.randrange(len(source))
            claim = source[at : at + rng.choice([1, 5, 29, 30, 31, 60])].upper() if i % 3 else "no such " * (i % 5 + 1)
            flags.append((audit, i, f"{audit}{i}", claim))
    flags.append(("A", 99, "A-empty", ""))
    flags.append(("B", 99, "B-empty", ""))
    flags.append(("C", 98, "C-null", None))
    return paras, flags


@pytest.mark.parametrize("small", [0, 4, 1000])
def test_match_paragraphs_equals_brute_force(spark, matching_case, small):
    paras, flags = matching_case
    got = paragraphs.match_paragraphs(
        spark.createDataFrame(paras, "audit_id string, para_no int, para string"),
        spark.createDataFrame(flags, "audit_id string, ord int, flag_id string, claim string"),
        small=small,
    )
    assert {(r.audit_id, r.para_no): r.flag_id for r in got.collect()} == brute_match(paras, flags)


def test_many_prefixes_in_one_audit(spark):
    """1,000 prefixes of 30 lengths over text that holds many of them; the shuffle stays near the text's size."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij ", k=rng.randrange(3, 12))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(400)] + [" ".join(rng.choices(words, k=8000))]
    flags = []
    for i in range(1000):
        source, n = rng.choice(texts), i % 30 + 1
        at = rng.randrange(len(source) - n)
        # two thirds are not in the text as they stand, but for the short ones
        claim = source[at : at + n] if i % 3 == 0 else "".join(rng.choices("abcdefghij XYZ", k=n))
        flags.append(("A", (i * 37) % 1000, f"f{i}", claim))
    # of many prefixes with the same beginning only the rest tells one from another
    flags += [("A", 1000 + i, f"g{i}", f"the same beginning {i:04d}") for i in range(500)]
    texts += [f"x the same beginning {i:04d} y" for i in range(0, 500, 50)]
    paras = [("A", i, t) for i, t in enumerate(texts)]
    for few in (flags, [f for f in flags if len(f[3]) > 7]):
        df = paragraphs.match_paragraphs(
            spark.createDataFrame(paras, "audit_id string, para_no int, para string").repartition(4),
            spark.createDataFrame(few, "audit_id string, ord int, flag_id string, claim string"),
        )
        moved = shuffled_bytes(df)
        assert {(r.audit_id, r.para_no): r.flag_id for r in df.collect()} == brute_match(paras, few)
    # the second one has no prefixes of a letter or two, which are nearly everywhere
    assert moved < 6 * sum(map(len, texts)), moved / sum(map(len, texts))


def test_rarest_gram_is_the_anchor(spark):
    rows = [("A", f"all share this {i}{i * 7 % 10}", i) for i in range(10)]
    found = paragraphs.anchors(
        spark.createDataFrame(rows, "k string, prefix string, ord int").selectExpr("k", "prefix", "struct(ord) AS hit"), "k"
    ).collect()
    assert len(found) == 10 and len({r.hash for r in found}) == 10 and {r.gram for r in found} == {16}


def test_anchors_are_found_by_bytes(spark):
    """A rolling hash of the bytes: equal grams have equal hashes wherever they stand."""
    texts = ["", "a", "naïve 😀 naïve", "x" * 40, "of the first line and the second"]
    for size, hashes in paragraphs.gram_hashes(np.frombuffer("".join(texts).encode(), np.uint8)):
        data, seen = "".join(texts).encode(), {}
        for at in range(len(data) - size + 1):
            assert seen.setdefault(data[at : at + size], hashes[at]) == hashes[at]
        assert len(set(map(int, seen.values()))) == len(seen)
    paras = [("A", i, f"{t} tail {t}") for i, t in enumerate(texts)]
    flags = [("A", i, f"f{i}", t[:29]) for i, t in enumerate(texts) if t]
    got = paragraphs.match_paragraphs(
        spark.createDataFrame(paras, "audit_id string, para_no int, para string"),
        spark.createDataFrame(flags, "audit_id string, ord int, flag_id string, claim string"), small=0,
    )
    assert {(r.audit_id, r.para_no): r.flag_id for r in got.collect()} == brute_match(paras, flags)


@pytest.mark.parametrize("n", [1, 9, 10, 11, 25, 40])
def test_segments_keep_every_substring(spark, n):
    text = "".join(chr(97 + i % 26) if i % 7 else "😀" for i in range(n))
    pieces = spark.createDataFrame([(text,)], "t string").select(paragraphs.segments(F.col("t"), 4, 10)).first()[0]
    assert all(any(text[i : i + 5] in p for p in pieces) for i in range(max(1, n - 4)))
    assert all(p in text and len(p) <= 14 for p in pieces)


# -- BM25 ------------------------------------------------------------------------------


def brute_bm25(claims, passages, k):
    def tokens(text):
        return [w for w in re.split(r"[\W_]+", text.lower()) if w]

    docs = {p: tokens(t) for p, t in passages}
    mean = sum(map(len, docs.values())) / len(docs)
    df = {}
    for ws in docs.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out = {}
    for c, text in claims:
        scores = []
        for p, ws in docs.items():
            total, hit = 0.0, False
            for w in set(tokens(text)) & set(ws):
                hit, tf = True, ws.count(w)
                idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
            if hit:
                scores.append((-round(total, 6), p))
        out[c] = [(p, -s) for s, p in sorted(scores)[:k]]
    return {c: v for c, v in out.items() if v}


@pytest.mark.parametrize("rare_df", [0, 1, 3, 1000])
def test_bm25_is_exact_for_any_split(spark, rare_df):
    rng = random.Random(11)
    common, rare = ["the", "of", "fee"], [f"w{i}" for i in range(60)]

    def text(n):
        return " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n))

    passages = [(i, text(rng.randrange(3, 25))) for i in range(40)]
    claims = [(i, text(rng.randrange(1, 8))) for i in range(60)] + [(90, "the of"), (91, "absent words"), (92, "")]
    index = retrieval.build_index(spark.createDataFrame(passages, "passage_id int, text string"))
    rows = retrieval.bm25_top_k(
        spark.createDataFrame(claims, "claim_id int, text string"), index, k=3, rare_df=rare_df
    ).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.claim_id, r["rank"])):
        got.setdefault(r.claim_id, []).append((r.passage_id, r.score))
    want = brute_bm25(claims, passages, 3)
    assert {c: [p for p, _ in v] for c, v in got.items()} == {c: [p for p, _ in v] for c, v in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for c in got for a, b in zip(got[c], want[c]))


def test_bm25_tasks_grow_with_the_claims(spark, monkeypatch):
    """A task holds the passages of its claims, so more claims need more tasks, not larger ones."""
    monkeypatch.setattr(retrieval, "TASK_TERMS", 20, raising=False)
    seen, write = [], retrieval.materialise

    def watched(df, purpose):
        if purpose == "first-round":
            df = df.select("*")
            seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, purpose)

    monkeypatch.setattr(retrieval, "materialise", watched)
    passages = [(i, f"the word{i} of fee{i % 4}") for i in range(12)]
    claims = [(i, f"the word{i % 12} and fee{i % 3} of absent{i}") for i in range(100)]
    index = retrieval.build_index(spark.createDataFrame(passages, "passage_id int, text string"), rare_df=1)
    rows = retrieval.bm25_top_k(spark.createDataFrame(claims, "claim_id int, text string"), index, k=3).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.claim_id, r["rank"])):
        got.setdefault(r.claim_id, []).append(r.passage_id)
    assert got == {c: [p for p, _ in v] for c, v in brute_bm25(claims, passages, 3).items()}
    # Four words of each claim are in the index: 400 rows, at most 20 a task.
    assert "RepartitionByExpression [claim_id" in seen[0] and ", 20" in seen[0]


def test_bm25_of_common_words_only(spark):
    """Every term is in most passages: exact, and blocks that can't reach the k-th score are not read.

    Passages without any structure are the hard case: a block of 64 holds a good one for every word."""
    rng = random.Random(12)
    common = [f"c{i}" for i in range(12)]

    def text(n, favourite=None):
        some = rng.sample(common, 7)  # every word is in more than half of the passages
        return " ".join(favourite if favourite and rng.random() < 0.4 else rng.choice(some) for _ in range(n))

    passages = [(i, text(rng.randrange(30, 300))) for i in range(6000)]
    passages += [(6000 + i, text(40, rng.choice(common))) for i in range(120)]  # a few stand out
    claims = [(i, " ".join(rng.sample(common, rng.choice([1, 2, 3])))) for i in range(40)]
    index = retrieval.build_index(spark.createDataFrame(passages, "passage_id int, text string"), rare_df=50)
    assert index.rare.isEmpty()
    asked = spark.createDataFrame(claims, "claim_id int, text string")
    got = {}
    for r in sorted(retrieval.bm25_top_k(asked, index, k=3).collect(), key=lambda r: (r.claim_id, r["rank"])):
        got.setdefault(r.claim_id, []).append((r.passage_id, r.score))
    want = brute_bm25(claims, passages, 3)
    assert {c: [p for p, _ in v] for c, v in got.items()} == {c: [p for p, _ in v] for c, v in want.items()}

    terms = asked.select("claim_id", F.explode(retrieval.words(F.col("text"))).alias("term")).join(index.common_terms, "term")
    nothing = spark.createDataFrame([], "claim_id int, passage_id int, score double")
    first, blocks = retrieval.surviving_blocks(terms, index, nothing, "claim_id", 3)
    read = blocks.count() + retrieval.FIRST_BLOCKS * len(claims)
    every = index.maxima[1].select("cell").distinct().count()
    assert every >= 90 and read < 0.7 * len(claims) * every
    scored = retrieval.common_scores(terms, index, blocks, "claim_id").count()
    assert scored <= blocks.count() * retrieval.BLOCK


def test_vector_top_k(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(200)]
    df = spark.createDataFrame(vectors, "vec_id int, embedding array<float>")
    query = df.where("vec_id = 3").select("embedding")
    got = [r.vec_id for r in retrieval.vector_top_k(df, query, 5).collect()]

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    want = sorted(vectors, key=lambda v: (-round(cosine(v[1], vectors[3][1]), 6), v[0]))[:5]
    assert got == [v[0] for v in want] and got[0] == 3


@pytest.mark.parametrize("block", [2, 1024])
def test_vector_top_k_many(spark, block):
    rng = random.Random(6)
    vectors = [(i, [rng.choice([-1.0, 0.5, 1.0]) for _ in range(3)]) for i in range(150)]
    df = spark.createDataFrame(vectors, "vec_id int, embedding array<float>").repartition(3)
    queries = df.where("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in retrieval.vector_top_k_many(df, queries, 4, block=block).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    for q in range(7):
        want = sorted(vectors, key=lambda v: (-round(cosine(v[1], vectors[q][1]), 6), v[0]))[:4]
        assert [got[q][i + 1] for i in range(4)] == [v[0] for v in want]


def test_vector_rings_are_skipped_and_hold_everything(spark):
    """Clustered directions: exact, most rings are never compared, and nothing is collected on the way."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 0.05
    rows[::500] = 0
    rows[1::600] = rows[1]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    df = df.unionByName(spark.createDataFrame([(9000, None), (9001, [None] * 16)], df.schema))
    queries = df.where("vec_id % 97 = 0 OR vec_id IN (1, 500)").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in retrieval.vector_top_k_many(df, queries, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    unit = rows / np.where(norms == 0, 1, norms)
    asked = [i for i in range(6000) if i % 97 == 0 or i in (1, 500)]
    for q in asked:
        scores = np.round(unit @ unit[q], 6)
        want = np.lexsort((np.arange(6000), -scores))[:5]
        assert [got[q][i + 1] for i in range(5)] == [(int(i), scores[i]) for i in want]
    assert set(got) == set(asked)

    pivots = df.where("vec_id BETWEEN 2 AND 65").agg(F.collect_list("embedding")).scalar()
    rings = retrieval._rings(df.where("vec_id < 9000"), pivots, "vec_id", "embedding", T.LongType()).collect()
    assert sorted(k for r in rings for k in r["keys"]) == list(range(6000))
    needed = pairs = 0
    for r in rings:
        units = np.frombuffer(r.units).reshape(-1, 16)
        bounds = retrieval.ring_bounds(unit[asked], np.frombuffer(r.pivot), r.near, r.far)
        scores = unit[asked] @ units.T
        assert (bounds >= scores.max(axis=1)).all()
        needed += int((bounds >= 0.95).sum())
        pairs += len(asked)
    assert needed < pairs / 4


# -- text ------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK + 3])
def test_start_offsets(spark, n):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: (x % 7).cast("bigint")).alias("a"))
    got = df.select(start_offsets(F.col("a"))).first()[0]
    want, total = [], 0
    for i in range(1, n + 1):
        want.append(total)
        total += i % 7
    assert got == want


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.text(alphabet="aB.!? \n\té😀<", max_size=60), min_size=1, max_size=8))
def test_sentences_cover_the_canonical_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = canonical.canonical_stream(df, "id", F.col("text")).collect()
    for i, raw in enumerate(texts):
        flat = re.sub(r"[ \t\n]+", " ", raw).strip(" ")
        mine = sorted((r for r in rows if r.id == i), key=lambda r: r.sentence_no)
        assert " ".join(r.sentence for r in mine) == flat
        assert all(flat[r.char_start : r.char_end] == r.sentence for r in mine)
        assert [r.sentence_no for r in mine] == list(range(1, len(mine) + 1))


def test_markup(spark):
    html = '<p>A&amp;lt; b</p><script>x("</p>")</script><STYLE>p{}</STYLE><!-- c --><br/>C&nbsp;d &copy;'
    html += " &#8217;&#x20AC;&#39;&#0;&#55296;&#99999999; &amp;#65;"
    row = spark.createDataFrame([(html,)], "h string").select(
        canonical.normalise_space(canonical.strip_markup(F.col("h")))
    ).first()[0]
    assert row == "A&lt; b\u2029C d © ’€'&#0;&#55296;&#99999999; &#65;"


def plain_text(html):
    """A page's text, character by character: the states of a tokenizer."""
    out, i, low = [], 0, html.lower()

    def tag_end(i):
        while i < len(html):
            if html[i] == ">":
                return i + 1
            if html[i] == "=":
                i += 1
                while html[i : i + 1] in (" ", "\n", "\t"):
                    i += 1
                if html[i : i + 1] in ("'", '"'):
                    close = html.find(html[i], i + 1)
                    if close < 0:
                        return len(html)
                    i = close
                else:
                    continue
            i += 1
        return i

    while i < len(html):
        if low.startswith("<!--", i):
            close = html.find("-->", i + 4)
            i = len(html) if close < 0 else close + 3
            out.append(" ")
        elif m := re.match(r"<(/?[a-z]|[!?])", low[i : i + 3]):
            name = re.match(r"</?([a-z0-9]*)", low[i : i + 20])[1]
            hidden = name in ("script", "style") and low[i + 1] != "/"
            i = tag_end(i + len(m[0]))
            if hidden:
                close = re.compile(rf"</{name}\s*>").search(low, i)
                i = close.end() if close else len(html)
            out.append("\u2029" if re.fullmatch(canonical.BLOCKS, name) else " ")
        else:
            out.append(html[i])
            i += 1
    text = re.sub("[ \n\t]+", " ", "".join(out))
    return re.sub(" ?\u2029[ \u2029]*", "\u2029", text).strip("\u2029").strip(" ")


PIECES = [
    "<p>", "</p>", "<br/>", "<b>", "<a href='x>y'>", '<a title="<p>" b=">">', "<script>", "</script>", "<SCRIPT src=a>", "<style>",
    "</STYLE >", "<!--", "-->", "<!DOCTYPE html>", "<?xml ?>", "x < y", "a > b", "don't", "=", "'", '"', "word.", " ", "<", "<p", "</", "\n", "<li a=b>",
]


@settings(max_examples=6, deadline=None)
@given(pages=st.lists(st.lists(st.sampled_from(PIECES), max_size=25), min_size=60, max_size=80))
def test_markup_against_a_tokenizer(spark, pages):
    pages = ["".join(p) for p in pages]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, h string").select(
        "i", "h", canonical.normalise_space(canonical.strip_markup(F.col("h"))).alias("t")
    ).collect()
    for r in rows:
        assert r.t == plain_text(r.h), r.h


def test_text_of_a_page_is_computed_once(spark):
    """No step of the markup stands twice in the plan: neither in branches of a condition nor in a filter."""
    pages = spark.createDataFrame([(1, "<p>a &amp; b. c&#39;s</p>"), (2, " "), (3, None)], "k int, html string")
    rows = canonical.canonical_stream(pages, "k", canonical.strip_markup(F.col("html")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("<!--") == 1 and plan.count(canonical.ENTITY_NUMBER) == 1
    assert [(r.k, r.sentence) for r in rows.collect()] == [(1, "a & b."), (1, "c's")]


def test_markup_is_linear(spark):
    """What is never closed is scanned once: a megabyte of each, in seconds."""
    import time

    units = ["<script", "<script>", "<!--", "<a b='", '<a b=">" ', "<style x>", "<", "<a ", "&amp", "&", "= '"]
    df = spark.createDataFrame([(u * (1_000_000 // len(u)),) for u in units], "h string").repartition(len(units))
    text = canonical.strip_markup(F.col("h"))
    start = time.time()
    assert df.select(F.length(canonical.normalise_space(text)).alias("n")).agg(F.sum("n")).first()[0] > 0
    assert time.time() - start < 60


def test_extracted_claims(spark):
    text = (
        "The fee is ₹24,800,000 or $5.5M. Delivery by 22 Dec 2026 or 2026-11-15! Uptime 99.99% a month."
        " Mail a.b@mail.example.org from 10.0.0.1? Nothing here. "
        + "Rent ₹2.5 Cr, ₹3.2Cr, ₹15 lakh, $5 million, USD 500 or $20 Meters by March 5, 2026 at 2 percent."
        + " Mail " + "a" * 80 + "@b.co!"
    )
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = canonical.extract_claims(canonical.canonical_stream(df, "id", F.col("text")), "id").collect()
    assert [(r.sentence_no, r.category, r.value) for r in sorted(rows, key=lambda r: (r.sentence_no, r.value_no))] == [
        (1, "COMMERCIAL_VALUE", "₹24,800,000"), (1, "COMMERCIAL_VALUE", "$5.5M"),
        (2, "DELIVERY_DATE", "22 Dec 2026"), (2, "DELIVERY_DATE", "2026-11-15"),
        (3, "SLA_GUARANTEE", "99.99%"),
        (4, "PII_SECURITY", "a.b@mail.example.org"), (4, "PII_SECURITY", "10.0.0.1"),
        *[(6, "COMMERCIAL_VALUE", x) for x in ("₹2.5 Cr", "₹3.2Cr", "₹15 lakh", "$5 million", "USD 500", "$20")],
        (6, "DELIVERY_DATE", "March 5, 2026"), (6, "SLA_GUARANTEE", "2 percent"),
        (7, "PII_SECURITY", "a" * 80 + "@b.co"),
    ]


# -- digests, precedence, stages -----------------------------------------------------------


def test_claim_root_is_one_tree_for_every_size(spark):
    import hashlib

    def chain(items):
        h = ""
        for x in items:
            h = hashlib.sha256((h + x).encode()).hexdigest()
        return h

    def root(items, fan_out, levels):
        for _ in range(levels):
            items = [chain(items[i : i + fan_out]) for i in range(0, len(items), fan_out)]
        return items[0]

    claims = [f"claim {i}" for i in range(7)]
    df = spark.createDataFrame([("A", i + 1, c) for i, c in enumerate(claims)] + [("B", 1, "é")], "a string, n int, t string")
    for fan_out, levels in ((1024, 7), (3, 7), (2, 3)):
        got = {r.a: r.claim_tree_root for r in passports.claim_root(df, "a", "n", "t", fan_out, levels).collect()}
        assert got == {"A": root(claims, fan_out, levels), "B": root(["é"], fan_out, levels)}
    stated = spark.createDataFrame([("A", "sha256chain:" + root(claims, 1024, 7)), ("B", "x"), ("C", "y")], "a string, claim_tree_root string")
    checked = {r.a: r.is_tampered for r in passports.check_claim_roots(df, stated, "a", "n", "t").collect()}
    assert checked == {"A": False, "B": True, "C": True}


def test_source_precedence(spark):
    rows = [
        (1, "s1", "SUPERSEDED", "2026-09-01"), (1, "s2", "SIGNED_EXECUTED", "2026-01-01"), (1, "s3", "SIGNED_EXECUTED", "2026-02-01"),
        (2, "s9", "DRAFT", None), (2, "s8", "DRAFT", "2020-01-01"), (3, "b", "DRAFT", None), (3, "a", "DRAFT", None), (3, "c", "OTHER", None),
    ]
    df = spark.createDataFrame(rows, "claim int, source_id string, authority string, freshness_date string")
    won = {r.claim: (r.source_id, r.candidates) for r in evidence.source_precedence(df, ["claim"]).collect()}
    assert won == {1: ("s3", 3), 2: ("s8", 2), 3: ("a", 3)}


def test_stage_board(spark):
    rows = [("A", "PARSING"), ("A", "UPLOADING"), ("B", "QUEUED"), ("C", "COMPLETED"), ("D", "RETRIEVING")]
    df = spark.createDataFrame(rows, "audit_id string, status string").withColumn("ts", F.current_timestamp())
    board = stages.stage_board(df).orderBy("audit_id", "stage_no").collect()
    state = {a: [r.state for r in board if r.audit_id == a] for a in "ABCD"}
    assert state["A"] == ["done", "done", "current", "pending", "pending", "pending"]
    assert state["B"][0] == "current" and set(state["C"]) == {"done"}
    assert {r.audit_id: r.progress for r in board} == {"A": "33%", "B": "0%", "C": "READY", "D": "0%"}
    status = {r.audit_id: r.stage for r in stages.furthest_stage(df).collect()}
    assert status == {"A": "PARSING", "B": "QUEUED", "C": "COMPLETED", "D": "RETRIEVING"}


@pytest.mark.parametrize("severities,expected", [
    (["INFORMATIONAL"], ("CLEAN", False)), ([], ("CLEAN", True)), (["LOW"], ("LOW", False)),
])
def test_heatmap(spark, severities, expected):
    flags = spark.createDataFrame(
        [("A", i, f"F{i}", s) for i, s in enumerate(severities)], "audit_id string, ord int, flag_id string, severity string"
    )
    audits = spark.createDataFrame([("A",)], "audit_id string")
    rows = paragraphs.heatmap(audits, flags).orderBy("section").collect()
    assert len(rows) == 5 and (rows[0].severity, rows[0].is_clean) == expected
    assert rows[4].count_text == "clean"
