from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import documents, odd_texts, words
from veridraft.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            found.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            found.append((3, m.start(), m.end()))
    return sorted(found)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{z}" for k, a, z in spans)


def card(rng, n=16):
    body = "".join(rng.choices("0123456789", k=n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


CASES = [
    "a.b@c.d", "a@b.c+d@e.f", "x@y", "@a.b", "a@b..c", "a@b.c.", "a@b@c.d", "é.a@b.cé", "a%b+c@d-e.f-g", "a@-.-",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "12.0001.2.3", "1.2.3", "0.0.0.0 255.255.255.255", "1..2.3.4",
    "+1 (499) 555-6503", "+1234567", "+12 34 56 78 9", "++123456789", "+1 - ", "+1234567890123456", "+1 234 567 89 .",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "0" * 13, "1" * 19, "0" * 20, "00 " * 8,
    "(415) 555-2671", "415.555.2671", "123-45-6789", "2024-01-02 03:04:05", "call 555 123 4567 now",
]


@pytest.mark.parametrize("seed", [1, 2])
def test_fixed_patterns(spark, seed):
    rng = random.Random(seed)
    bits = ["@", ".", "a", "b-", "1", "23", "+", " ", "(", ")", "255", "é", "\n", "4111", "-"]
    texts = CASES + ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(400)]
    texts += [f"{card(rng, n)} tel {words(rng, 3)}" for n in range(12, 21)] + [t or "" for t in odd_texts(rng)]
    rows = {r.doc_id: r for r in pii.find_personal_data(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = plain_base(t)
        n = Counter(k for k, _, _ in want)
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == (n[0], n[1], n[2], n[3]), t
        assert rows[i].base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), t
        spans = [s for s in rows[i].spans.split(",") if s]
        assert [s for s in spans if s.split(":")[0] in pii.KINDS[:4]] == [x for x in listed(want).split(",") if x]
        assert [(s["kind"], s["start"], s["stop"]) for s in rows[i].found] == sorted((s["kind"], s["start"], s["stop"]) for s in rows[i].found)


def test_linear_on_long_runs(spark):
    """Texts on which the patterns as written would take quadratic time or deep recursion."""
    texts = ["a" * 200_000, "1" * 200_000, "1." * 60_000, "a@" + "b." * 60_000, "+1" + " " * 100_000, "1 " * 100_000]
    rows = {r.doc_id: r for r in pii.find_personal_data(documents(spark, texts)).collect()}
    assert [rows[i].n_email for i in range(6)] == [0, 0, 0, 1, 0, 0]


def test_learns_what_the_patterns_miss_and_leaves_the_rest(spark):
    """Phone numbers with a cue are learnt; years, amounts and words are not."""
    rng = random.Random(3)
    number = lambda: f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    texts = []
    for k in range(800):
        filler = words(rng, 5)
        texts.append([
            f"{filler} phone +1 {number()} {filler}",
            f"{filler} in 19{rng.randint(10, 99)} or 20{rng.randint(10, 99)} {filler}",
            f"{filler} order {rng.randint(10**7, 10**8 - 1)} {filler}",
            f"{filler} someone@{rng.choice(['a.org', 'b.com'])} {filler}",
        ][k % 4])
    texts += [words(rng, 30) for _ in range(50)]
    rows = pii.find_personal_data(documents(spark, texts)).collect()
    by_kind = [[r for r in rows if r.doc_id < 800 and r.doc_id % 4 == k] for k in range(4)]
    assert all(r.n_phone == 1 for r in by_kind[0]) and all(r.n_email == 1 for r in by_kind[3])
    assert sum(r.n_more for r in by_kind[1] + by_kind[2]) == 0
    assert all(r.spans == "" for r in rows if r.doc_id >= 800)


def test_calibrated_probabilities(spark):
    """Combinations that are always, sometimes and never confirmed come out in that order."""
    combos = [tuple(int(j == k) for j in range(len(pii.FEATURES))) for k in range(3)]
    rows = []
    for f, share in zip(combos, (1.0, 0.5, 0.0)):
        for kept_out in (True, False):
            rows += [(f, True, kept_out, int(1000 * share)), (f, False, kept_out, int(1000 * (1 - share)))]
    inner = ", ".join(f"{f}: int" for f in pii.FEATURES)
    df = spark.createDataFrame([r for r in rows if r[3]], f"f struct<{inner}>, label boolean, kept_out boolean, n long")
    p = {tuple(r.f): r.p for r in pii.probabilities(df).collect()}
    assert p[combos[0]] > 0.97 and abs(p[combos[1]] - 0.5) < 0.05 and p[combos[2]] < 0.03


def test_redaction(spark):
    df = spark.createDataFrame(
        [("mail é@ a@b.co or +123456789.", [(0, 8, 14), (3, 18, 28)]), ("abcdef", [(1, 1, 4), (2, 2, 3), (3, 4, 5)]), ("none", [])],
        "text string, found array<struct<kind:int,start:int,stop:int>>",
    )
    got = [r[0] for r in df.select(pii.redacted(F.col("text"), F.col("found"))).collect()]
    assert got == ["mail é@ [EMAIL] or [PHONE].", "a[IP][PHONE]f", "none"]


def test_empty_and_clashing_columns(spark):
    assert pii.find_personal_data(documents(spark, [])).count() == 0
    df = documents(spark, ["a@b.co", None, "x"], extra=["spans", "found", "f"])
    rows = pii.find_personal_data(df, columns=df.columns).orderBy("doc_id").collect()
    assert [r.spans for r in rows] == ["email:0:6", "", ""] and rows[0].f == "x"
