from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from veridraft.llm import repair

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("gone", T.BooleanType()), T.StructField("digest", T.StringType()), T.StructField("audit", T.StringType()),
])
GRAMMAR = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\f\r"


def table(spark, rows):
    return spark.createDataFrame([(*r[:4], r[4] if len(r) > 4 else False, "x", "y") for r in rows], SCHEMA)


def faults(turns):
    """Of (role, text) in order."""
    seen, found = set(), []
    for role, text in turns:
        said = text.rstrip(BLANK)
        found.append(
            "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        )
        seen.add((role, text))
    return found


def all_repairs(turns, kinds, most):
    """(cost, audit, turns) of every repair with up to ``most`` inserts in each place, two at the end; nothing clever."""

    def inserts(most):
        return [("i", x) for n in range(most + 1) for x in itertools.product(("user", "assistant"), repeat=n)]

    def ways(role, text, kind):
        yield 2, "D", ()
        if kind not in ("blank", "duplicate"):
            more = 5 if kind == "truncated" else 0
            yield more, "K", ((role, text),)
            for new in ("user", "assistant"):
                yield 1 + more, "R", ((new, text),)

    parts = []
    for (role, text), kind in zip(turns, kinds):
        parts += [inserts(most), [("w", x) for x in ways(role, text, kind)]]
    parts.append(inserts(2))
    for choice in itertools.product(*parts):
        cost, audit, out = 0, "", []
        for kind, x in choice:
            if kind == "i":
                cost, audit = cost + 5 * len(x), audit + "I" * len(x)
                out += [(r, "") for r in x]
            else:
                cost, audit = cost + x[0], audit + x[1]
                out += x[2]
        if GRAMMAR.fullmatch("".join((r[:1] or "?") for r, _ in out)):
            yield cost, audit, out


def slow(turns, most=1):
    cost, audit, out = min(all_repairs(turns, faults(turns), most), key=lambda x: x[:2])
    return cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def expected(rows, most=1):
    """{conv_id: the result's other columns} of (conv_id, turn, role, text, gone) rows."""
    found = {}
    for conv in {r[0] for r in rows}:
        mine = [(t, " " if role is None else role, " " if text is None else text)
                for c, t, role, text, gone in rows if c == conv and not gone]
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
        turns = [x[1:] for x in mine]
        kinds = faults(turns)
        numbers = [x[0] for x in mine if x[0] is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(turns, turns[1:])]
        found[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), *slow(turns, most),
        )
    return found


def result(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def random_rows(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    texts = ["Yes.", "No!", "cut", "", " \n", None, "Why?", "Ünd.", "end.\r\n "]
    turns = sorted(rng.choices([None, *range(8)], k=n), key=lambda t: (t is not None, t))
    return [(conv, t, rng.choice(roles), rng.choice(texts), rng.random() < 0.1) for t in turns]


def test_letters_against_every_repair():
    """All signatures of up to two turns, many of three: cheapest and ASCII-least, shared endings or not."""
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}

    def turns(word):
        return [(roles.get(c.lower(), "user"), "" if c == "x" else f"{k}{'' if c.isupper() else '.'}") for k, c in enumerate(word)]

    words = ["".join(w) for n in range(4) for w in itertools.product("suaoSUAOx", repeat=n)]
    words = [w for w in words if len(w) < 3] + random.Random(1).sample([w for w in words if len(w) == 3], 150)
    endings = repair.Endings()
    for word in sorted(words, key=lambda w: w[::-1]):
        want = min(x[:2] for x in all_repairs(turns(word), faults(turns(word)), 2 if len(word) < 3 else 1))
        assert endings.repair(word[::-1]) == want, word
        assert repair.Endings().repair(word[::-1]) == want


def test_nodes_are_shared_and_few():
    rng = random.Random(2)
    words = sorted("".join(rng.choices("suaoSUAOx", k=rng.randint(0, 12))) + "uaxUa" * 20 for _ in range(2000))
    words.sort(key=lambda w: w[::-1])
    endings, made = repair.Endings(), 0
    before = endings.automaton.before

    def counted(*args):
        nonlocal made
        made += 1
        return before(*args)

    endings.automaton.before = counted
    for w in words:
        endings.repair(w[::-1])
    suffixes = {w[i:] for w in words for i in range(len(w))}
    assert made == len(suffixes)  # once per node, across all signatures
    assert len(endings.automaton.costs) < 60
    cost, audit = repair.Endings().repair("au" * 300_000)
    assert cost == 0 and audit == "K" * 600_000


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_against_every_repair(spark, seed):
    rng = random.Random(seed)
    rows = [r for conv in range(60) for r in random_rows(rng, conv, rng.randint(1, 4))]
    rows += random_rows(rng, None, 3) + [(100, 1, "user", "Hi.", True), (101, None, None, None, False)]
    df = table(spark, rows)
    assert result(repair.repair_conversations(df, gone="gone")) == expected(rows)
    out = {}
    for r in sorted(repair.repaired_turns(df, gone="gone").collect(), key=lambda r: r.place):
        out.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, found in expected(rows).items():
        assert hashlib.sha256("\n".join(out.get(conv, [])).encode()).hexdigest() == found[-1]


def test_a_conversation_over_many_partitions(spark):
    """One conversation holds most rows; its pieces give the same as the whole."""
    rows = [(7, k // 2, "user" if k % 2 else "assistant", f"{k}." if k % 11 else "cut", False) for k in range(6000)]
    rows += [(c, 0, "user", "Hi.", False) for c in range(8, 300)]
    df = table(spark, rows).repartition(16)
    found = result(repair.repair_conversations(df))
    turns = [("user" if k % 2 else "assistant", f"{k}." if k % 11 else "cut", k // 2) for k in range(6000)]
    turns.sort(key=lambda x: (x[2], x[0]))
    kinds = faults([x[:2] for x in turns])
    gaps, blank, duplicate, truncated, illegal, cost, audit, _ = found[7]
    assert (gaps, blank, truncated) == (0, 0, kinds.count("truncated")) and duplicate == kinds.count("duplicate")
    assert illegal == sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    assert len(audit.replace("I", "")) == 6000
    assert found[8][:7] == (0, 0, 0, 0, 0, 2, "D") and len(found) == 293


def test_damage(spark):
    rows = [(c, t, "assistant", "a.b!c?", False) for c in (3, None) for t in [None, *range(60)]]
    got = sorted(
        repair.damaged(table(spark, rows)).collect(), key=lambda r: (r.conv_id or -1, -1 if r.turn is None else r.turn)
    )
    want = []
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1])):
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        one = (c, t, "user" if d == 4 else role, "" if d == 1 else "abc" if d == 2 else text, d == 0)
        want += [one] * (2 if d == 3 else 1)
    assert [tuple(r) for r in got] == want


def test_empty_and_long(spark):
    assert repair.repair_conversations(table(spark, [])).count() == 0
    rows = [(1, 0, "user", "x" * 3_000_000 + ".", False), (1, 1, "assistant", " " * 2_000_000 + "y", False)]
    assert result(repair.repair_conversations(table(spark, rows))) == expected(rows)
    df = table(spark, [(5, 0, "user", "a.", False), (5, 0, "user", "a.", False)])
    assert result(repair.repair_conversations(df))[5][:7] == (0, 0, 1, 0, 1, 4, "DD")
